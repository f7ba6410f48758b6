"""Query of BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import bpe

#: The public tokenizer's file.
PATH = public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.round_trip(docs, PATH)


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
