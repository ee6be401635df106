"""The corpus queries by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import query_divergence, query_fill_middle, query_html, query_lines, query_mixing, query_packing, query_pii, query_quality, query_secrets, query_simhash, query_substring, query_tokens, query_topk

MODULES = [query_divergence, query_fill_middle, query_html, query_lines, query_mixing, query_packing, query_pii, query_quality, query_secrets, query_simhash, query_substring, query_tokens, query_topk]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
