"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import quality_classifier
from gaugeline.llm._store import Store


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.noisy(quality_classifier.weighed(docs, model), "doc_id").select("doc_id", "n_grams", "log_weight", "gumbel")
    rows = Store(spark, "draw").keep(rows)
    return rows.withColumn("kept", quality_classifier.draw(rows, "doc_id").takes("doc_id"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
