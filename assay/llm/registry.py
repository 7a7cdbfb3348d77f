"""Queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from assay.llm.decontaminate import op9_decontaminate
from assay.llm.line_crf import op1_line_crf
from assay.llm.line_dedup import OP6_SQL, op6_line_runs
from assay.llm.merkle_manifest import OP12_SQL, op12_merkle
from assay.llm.mixing import OP4_SQL, op4_mixing
from assay.llm.packing import op11_packing
from assay.llm.quality_knn import op8_quality_knn
from assay.llm.radix_dedup import OP7_SQL, op7_radix_dedup
from assay.llm.revisits import OP5_SQL, op5_revisits
from assay.llm.sketch_join import OP3_SQL, op3_sketch_join
from assay.llm.source_audit import OP13_SQL, op13_source_audit
from assay.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from assay.llm.tool_calls import OP2_SQL, op2_tool_calls

QUERIES = {f.__name__: f for f in (op1_line_crf, op2_tool_calls, op3_sketch_join, op4_mixing, op5_revisits, op6_line_runs, op7_radix_dedup, op8_quality_knn, op9_decontaminate, op10_suffix_dedup, op11_packing, op12_merkle, op13_source_audit)}
SQL = {"op2_tool_calls": OP2_SQL, "op3_sketch_join": OP3_SQL, "op4_mixing": OP4_SQL, "op5_revisits": OP5_SQL, "op6_line_runs": OP6_SQL, "op7_radix_dedup": OP7_SQL, "op10_suffix_dedup": OP10_SQL, "op12_merkle": OP12_SQL, "op13_source_audit": OP13_SQL}
