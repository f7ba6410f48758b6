"""Intermediate tables in the folder that driver and executors share.

Results that are not yet read stand on them, so they stay until ``sweep`` is called or the driver's
process ends, also where a run has failed.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, one on this machine, which is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = f"file://{tempfile.mkdtemp(prefix='gaugeline-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_stores: list[tuple[SparkSession, str]] = []


def sweep() -> None:
    """Removes every table that this process has kept; results that stand on them can no longer be read."""
    while _stores:
        _delete(*_stores.pop())


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM can be gone
        sweep()


class Store:
    """Tables written once and read again; each cuts lineage and outlives any executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/gaugeline-{what}-{uuid.uuid4().hex}"
        self.n = 0
        _stores.append((spark, self.dir))

    def keep(self, df: DataFrame) -> DataFrame:
        """df as written and read again."""
        at = f"{self.dir}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._kept_at = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a kept table that nothing will read any more."""
        if at := getattr(df, "_kept_at", None):
            _delete(self.spark, at)
