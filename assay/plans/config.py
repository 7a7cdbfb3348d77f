"""Configuration: defaults, YAML files, and a hash of what is in force."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

# The defaults of every stage.
DEFAULTS: dict = {
    "retrieval": {"top_k": 2, "bm25_k1": 1.5, "bm25_b": 0.75, "score_precision": 4},
    "matching": {"max_gap": 2},
    "grounding": {"precision_weight": 0.85, "min_quote_span": 4, "quote_bonus": 0.15, "numeric_penalty": 0.25, "low_grounding_threshold": 0.3, "score_precision": 4},
    "risk": {"levels": {"low": 1, "medium": 2, "high": 3, "critical": 4}, "unknown_severity": 4},
    "gates": {"disqualify_must_not_claim_at_severity": 3},
    "aggregation": {
        "weights": {"retrieval_hit": 0.10, "must_include_pass": 0.20, "must_not_claim_pass": 0.25, "grounding_score": 0.20, "judge_faithfulness": 0.15, "judge_clarity": 0.05, "judge_winner_vote": 0.05},
        "min_margin_for_promotion": 0.02,
        "score_precision": 4,
    },
    "judge": {"provider": "openai", "model": "gpt-4o-mini", "temperature": 0, "max_tokens": 4096, "score_min": 1, "score_max": 5, "max_retries": 1, "backend_order": ["cache", "live", "stub"]},
    "paths": {},
}


class ConfigError(ValueError):
    """The configuration can't be used."""


def defaults() -> dict:
    return copy.deepcopy(DEFAULTS)


def load_config(path: str) -> dict:
    """A YAML mapping with every section of DEFAULTS."""
    import yaml

    file = Path(path)
    if not file.is_file():
        raise ConfigError(f"no configuration file at {path}")
    try:
        config = yaml.safe_load(file.read_text(encoding="utf-8"))
    except yaml.YAMLError as error:
        raise ConfigError(f"{path} isn't YAML: {error}") from error
    if not isinstance(config, dict):
        raise ConfigError(f"{path} must hold a mapping")
    if lacking := [section for section in DEFAULTS if section not in config]:
        raise ConfigError(f"{path} lacks {', '.join(lacking)}")
    return config


def config_hash(config: dict) -> str:
    """SHA-256 of the configuration as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
