"""All registered queries outside the subpackage llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES (name -> function) and SQL (name -> DuckDB text).
MODULES: tuple[str, ...] = ("q_cohort", "q_validation", "q_planes", "q_capture", "q_images", "q_refusals", "q_results", "q_geometry")


def _each():
    return (import_module(f"{__package__}.{m}") for m in MODULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _each() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _each() for k, s in m.SQL.items()}
