"""The request handler as a stateless stream: an extension, as requests are otherwise handled one by one.

Rows go through the same columns as a batch; nothing is kept between them, so any number of
executors can share a stream, and a lost one only repeats its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import headers

SCHEMA = "id string, content binary, declared string, unverified boolean, qc_passed boolean, publishable boolean, elapsed_ms double"


def requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def handled(rows: DataFrame) -> DataFrame:
    """(id, status_code, outcome, reason, fmt, content_type_mismatch, within_p50, within_p95); works on batches and streams."""
    c = F.col("content")
    fmt = headers.sniffed(c)
    rows = rows.withColumn("fmt", fmt)
    size = F.when(F.col("fmt") == "png", headers.png_size(c)).when(F.col("fmt") == "webp", headers.webp_size(c)).when(F.col("fmt") == "jpeg", headers.jpeg_size(c))
    rows = rows.withColumn("size", size)
    refusal = headers.limit_refusal(F.col("fmt"), F.col("size.width"), F.col("size.height"))
    out = headers.outcome(F.octet_length("content").cast("long"), refusal, F.col("unverified"), F.col("qc_passed"), F.col("publishable"))
    rows = rows.withColumn("o", out).withColumn("l", headers.latency_flags(F.col("elapsed_ms")))
    return rows.select("id", "o.status_code", "o.outcome", "o.reason", "fmt", headers.content_type_mismatch(F.col("fmt"), F.col("declared")).alias("content_type_mismatch"), "l.within_p50", "l.within_p95")


def start(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """The stream from a folder of request files to a folder of results; each file is handled once."""
    return handled(requests(spark, source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
