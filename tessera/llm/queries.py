"""Queries of this subpackage, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.chunks import op8_substring_dedup
from tessera.llm.decontaminate import op3_benchmark_decontamination
from tessera.llm.html import op2_html_extraction
from tessera.llm.jaccard import op10_ngram_jaccard_join
from tessera.llm.packing import op5_best_fit_packing
from tessera.llm.quality import op9_quality_classifier
from tessera.llm.secrets import op7_secret_scans
from tessera.llm.sql import OP3_SQL, OP4_SQL, OP10_SQL
from tessera.llm.suffix import op6_suffix_array_dedup
from tessera.llm.tokens import op1_token_counts
from tessera.llm.topk import op4_exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_exact_topk": op4_exact_topk,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {"op3_benchmark_decontamination": OP3_SQL, "op4_exact_topk": OP4_SQL, "op10_ngram_jaccard_join": OP10_SQL}
