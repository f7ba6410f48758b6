"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, with what they held:
a column that is named like one of an operator's own is set aside while the operator runs.

Defined results. Nulls in any column are passed on. A null or blank text has no token, so the
classifier drops it. Repeated rows weigh the same and are drawn together; near-dedup keeps one of the rows of an id, the one with the
smallest text and, of equal texts, the smallest other columns. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gaugeline.llm import bpe, mixing, neardup, q_mixing, q_tokens, quality_classifier, secret_scan
from gaugeline.llm._store import Store

#: The corpus drops one of two documents from a similarity of 0.8 on (op3_neardup keeps its own contract); 50 bands miss such a pair with 3e-7.
SIMILAR, BANDS = (100, 80), 50


def _set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all but the needed columns under names that no operator uses, and the columns that bring them back."""
    names = {c: c if c in needed else f"__aside_{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(new).alias(c) for c, new in names.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier draws: as many as are expected to be good. The others, and texts without a token, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, back = _set_aside(docs, "doc_id", "text")
    return quality_classifier.classified(spark, plain, labels).where("drawn").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows with one id the one with the smallest text stays. Rows without id are in no group and stay.
    """
    plain, back = _set_aside(docs, "doc_id", "text")
    kept = neardup.near_duplicates(plain, similar=SIMILAR, bands=BANDS).where("kept and doc_id is not null").select("doc_id").distinct()
    sortable = [f.name for f in plain.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, T.AtomicType)]
    w = Window.partitionBy("doc_id").orderBy("text", *sortable)
    own = plain.join(kept, "doc_id", "left_semi").withColumn("__row", F.row_number().over(w)).where("__row = 1")
    return own.select(back).union(plain.where("doc_id is null").select(back))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span of a secret replaced by a mark, and its number of characters as it then is."""
    plain, back = _set_aside(docs, "text", "n_chars")
    found = secret_scan.spans_of(plain)
    hit = F.size("spans") > 0
    text = F.when(hit, secret_scan.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    n = F.when(hit, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": n}).select(back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture: the written files, by name, hold it from its first row to its last."""
    plain, back = _set_aside(docs, "doc_id", "source")
    placed = mixing.mixed(plain, q_mixing.WEIGHTS, q_mixing.OTHER)
    return placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, mix_part, mix_row, n_tokens, ids, decoded_sha256) of every document.

    mix_part and mix_row are the document's file number and row in what the mixing stage
    wrote, so sorting by them gives the mixture; null where docs comes from no file.
    """
    own = ["doc_id", "source", "text"]
    try:
        docs = docs.select(*own, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        docs = docs.select(*own, F.lit(None).cast("int").alias("mix_part"), F.lit(None).cast("long").alias("mix_row"))
    ids = bpe.tokens_of(docs, q_tokens.PATH, digest="decoded_sha256")
    return ids.select("doc_id", "source", "mix_part", "mix_row", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_neardedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the classifier, MinHash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else store.keep(out)
    return docs
