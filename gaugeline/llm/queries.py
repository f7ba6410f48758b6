"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries. Each has QUERIES (name -> function) and SQL (name -> DuckDB text, where SQL can express it).
MODULES = ("q_tokens", "q_secrets", "q_neardup", "q_mixing", "q_sharding", "q_rules", "q_licences", "q_topk", "q_pages", "q_classifier")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
