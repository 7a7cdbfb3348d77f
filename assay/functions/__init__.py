"""Column functions: tokens, stems, phrase matching, grounding."""
