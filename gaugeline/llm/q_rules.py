"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import quality_rules


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_rules.fit(quality_rules.sample(docs, labels))
    return quality_rules.judged(docs, weights).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share")


QUERIES = {"op5_quality_rules": op5_quality_rules}
SQL: dict[str, str] = {}
