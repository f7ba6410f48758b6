"""Query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import html_extract


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html": op6_html}
SQL: dict[str, str] = {}
