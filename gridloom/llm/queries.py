"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, jaccard_join, license_scan, packing, quality, secret_scan, token_counts, token_output, topk_search, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": token_output.op1_token_output,
    "op2_quality": quality.op2_quality,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_packing": packing.op9_packing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES: dict[str, str] = {"op3_topk_search": topk_search.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE}
