"""Quality classifier by importance resampling.

Two generative models over hashed n-grams: the target's, from labelled texts of good
quality, and the raw corpus's, from every text. A document's log weight is the sum over
its n-grams of the log ratio of the two, less a margin for each n-gram. Gumbel noise is added to it, and the k
documents with the largest sums are drawn: a sample without replacement in proportion to the weights.
Every document with an n-gram takes part in the draw. By default k is the number of
log weights of 0 or more: so many documents are expected to be good, and the draw decides which they are. Far from 0 the noise
changes nothing; near it a document of either side can be drawn for one of the other.

N-grams are tokens, pairs of neighbouring tokens, and triples of token shapes (case, length, kind,
and whether a token repeats one of the two before it). A token is a run of
letters, digits and non-ASCII characters, or a run of other visible characters.

The raw model's counts cover all rows: each task sends one count for each bucket that it met,
BUCKETS at most. The target's come from at most SAMPLE labelled documents, counted where they lie: the driver
receives counts and weights, no texts. The margin is the value of the log ratio for each n-gram
with the best sum of the rate of bad documents below it and KEEP times the rate of good
ones above it, in the sample: losing a good one weighs more. Fitted on one half of the labels of sf0.1 and
counted on the other, both ways, KEEP = 10 lets 6 of 571 bad documents through and loses none of
3,409 good ones; 1 lets 3 through and loses 20.

Defined results. A text without tokens (null, empty, blank) has weight 0 and is not
drawn. Repeated rows have equal weights and noise, and are drawn together; so are rows with one key and equal weights. Ties in
the draw go to the smaller key. A key whose labels contradict each other takes no part in the fit; of
texts with one key the smallest does. Without labelled rows of good quality the target is the raw
model, and every document with a token is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import _text
from gaugeline.llm._store import Store

#: Hash buckets, and labelled documents of each quality in the fit, at most.
BUCKETS, SAMPLE = 1 << 15, 4000
#: Added to every count.
PRIOR = 1.0
#: Bins of a pass of the draw.
BINS = 4096
#: How much more a good document kept counts than a bad one rejected where the threshold is placed.
KEEP = 10.0

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GRAM = _text.mix64(np.arange(77, 80, dtype=np.uint64)) | np.uint64(1)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (_text.mix64(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of consecutive texts, and the text of each."""
    base, n_text = int(off[0]), len(off) - 1
    body, cut = raw[base : int(off[-1])], off - base
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.where(_text._SPACE[body], 0, np.where(_WORD[body], 1, 2)).astype(np.int8)
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[cut[:-1][cut[:-1] < n]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    h = _text.span_hashes(body, starts, ends)
    owner = np.searchsorted(cut, starts, "right") - 1
    upper = (body >= 65) & (body <= 90)
    caps = np.concatenate([[0], np.cumsum(upper)])
    n_caps, size = caps[ends] - caps[starts], ends - starts
    repeat = np.zeros(len(h), np.int64)
    repeat[1:] |= h[1:] == h[:-1]
    repeat[2:] |= h[2:] == h[:-2]
    shape = kind[starts] + 3 * np.minimum(n_caps, 2) + 9 * (n_caps == size) + 18 * repeat + 36 * np.minimum(size, 3) * (kind[starts] == 2)
    s = _text.mix64(shape.astype(np.uint64) + np.uint64(1))
    out, own = [_bucket(h)], [owner]
    if len(h) > 1:
        near = owner[1:] == owner[:-1]
        out.append(_bucket((h[:-1] * _GRAM[0] + h[1:])[near]))
        own.append(owner[1:][near])
    if len(h) > 2:
        near = owner[2:] == owner[:-2]
        out.append(_bucket((s[:-2] * _GRAM[1] + s[1:-1] * _GRAM[2] + s[2:])[near]))
        own.append(owner[2:][near])
    return np.concatenate(out), np.concatenate(own)


def counts_of(texts: pa.Array) -> np.ndarray:
    """N-grams by bucket, of all texts together."""
    out = np.zeros(BUCKETS, np.int64)
    raw, off = _text.column_bytes(texts)
    for i, j in _text.groups(off):
        out += np.bincount(grams(raw, off[i : j + 1])[0], minlength=BUCKETS)
    return out


def weights_of(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text, the sum of the log ratios of its n-grams, and their number."""
    raw, off = _text.column_bytes(texts)
    sums, sizes = [], []
    for i, j in _text.groups(off):
        g, own = grams(raw, off[i : j + 1])
        sums.append(np.bincount(own, weights=ratio[g], minlength=j - i))
        sizes.append(np.bincount(own, minlength=j - i))
    if not sums:
        return np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(sums), np.concatenate(sizes)


def total_counts(texts: DataFrame) -> np.ndarray:
    """N-grams by bucket over every row of one column; the driver receives one sum for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += counts_of(b.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(place, quality, text): at most ``most`` labelled texts of each quality, those whose keys' hashes are smallest; place counts from 0 in a quality."""
    known = labels.where("quality in (0, 1)").groupBy(F.col(key).alias("key")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and key is not null")
    known = known.select("key", "quality", F.xxhash64("key").alias("h"))
    w = Window.partitionBy("quality").orderBy("h", "key")  # 2 * most rows
    parts = [known.where(F.col("quality") == q).orderBy("h", "key").limit(most) for q in (0, 1)]
    few = parts[0].union(parts[1]).withColumn("place", F.row_number().over(w) - 1)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key").where("text is not null")  # 2 * most rows
    return rows.groupBy("key", "quality", "place").agg(F.min("text").alias("text")).select("place", "quality", "text")


class Model:
    """The log ratio of each bucket, and the margin for each n-gram."""

    def __init__(self, ratio: np.ndarray, least: float):
        self.ratio, self.least = ratio, least


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    """Both models and the margin."""
    store = Store(docs.sparkSession, "classifier")
    raw = total_counts(docs.select(text))
    known = store.keep(sample(docs, labels, key, text, most))
    # every other text of good quality makes the target; the rest, with the others, place the margin
    target = total_counts(known.where("quality = 1 and place % 2 = 0").select("text"))
    if not target.any():
        return Model(np.zeros(BUCKETS), -np.inf)
    ratio = np.log((target + PRIOR) / (target.sum() + PRIOR * BUCKETS)) - np.log((raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS))
    held = weighed(known.where("quality = 0 or place % 2 = 1"), Model(ratio, 0.0)).where("n_grams > 0").select(F.col("log_weight") / F.col("n_grams"), "quality").collect()  # 2 * most rows
    store.drop(known)
    x = np.array([r[0] for r in held], float)
    return Model(ratio, threshold(x, np.array([r[1] for r in held], int)))


def threshold(x: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The cut with the best sum of the rate of bad rejected and ``keep`` times that of good kept, of equals the lowest; halfway between its neighbours."""
    if not len(x) or good.all():
        return -np.inf
    order = np.argsort(x, kind="stable")
    x, good = x[order], good[order]
    right = np.concatenate([[0], np.cumsum(1 - good)]) / max((1 - good).sum(), 1) + keep * (1 - np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1))
    k = int(right.argmax())
    if k == 0:
        return -np.inf
    return float((x[k - 1] + x[k]) / 2) if k < len(x) else float(x[-1])


def weighed(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``log_weight`` (sum of log ratio less margin over the n-grams) and ``n_grams``; columns of these names are replaced."""
    new = ["log_weight", "n_grams"]
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.LongType())])
    held = docs.sparkSession.sparkContext.broadcast(model.ratio)  # BUCKETS numbers
    least = model.least if np.isfinite(model.least) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = weights_of(b.column(b.schema.get_field_index(text)), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w - least * n), pa.array(n.astype(np.int64))], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, schema)


def gumbel(key: str, seed: int = 0):
    """Column: standard Gumbel noise that depends on the key and the seed alone."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    return -F.log(-F.log(u))


@dataclass
class Draw:
    """What the draw takes: all with a larger sum than ``edge``, and of those with an equal one the keys up to ``key``; everything without an edge."""

    edge: float | None
    key: object = None

    def takes(self, key: str):
        """Column over weighed rows with ``gumbel``: whether a row is drawn."""
        able = F.col("n_grams") > 0
        if self.edge is None:
            return able
        tied = F.col(key).isNull() if self.key is None else F.coalesce(F.col(key) <= F.lit(self.key), F.lit(True))
        return able & ((F.col("gumbel") > self.edge) | ((F.col("gumbel") == self.edge) & tied))


def draw(rows: DataFrame, key: str, k: int | None = None) -> Draw:
    """The edge of the k largest ``gumbel`` of weighed rows, by counting bins of what is left, BINS at a time, until one value is left.

    k: by default the number of rows with a log weight of 0 or more.
    """
    able = rows.where("n_grams > 0")
    x = able.agg(F.count("*").alias("n"), F.count_if(F.col("log_weight") >= 0).alias("k"), F.min("gumbel").alias("lo"), F.max("gumbel").alias("hi")).first()
    need = x["k"] if k is None else k
    if need >= x["n"]:
        return Draw(None)
    if need <= 0:
        return Draw(float("inf"))
    lo, hi, left = x["lo"], x["hi"], F.lit(True)
    while lo < hi:
        width = (hi - lo) / BINS
        # the top bin is 0; rounding moves a row by a bin at most, in the count and in the choice alike
        digit = F.least(F.greatest(F.floor((F.lit(hi) - F.col("gumbel")) / F.lit(width)), F.lit(0)), F.lit(BINS - 1)) if width > 0 else F.when(F.col("gumbel") == hi, 0).otherwise(1)
        sums = able.where(left).groupBy(digit.alias("d")).agg(F.count("*").alias("n"), F.min("gumbel").alias("lo"), F.max("gumbel").alias("hi"))
        for r in sorted(sums.collect()):  # BINS rows at most
            if need <= r["n"]:
                break
            need -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):  # nothing was set apart: from here by value
            lo, hi = hi, hi
            break
        lo, hi, left = r["lo"], r["hi"], left & (digit == r["d"])
    # rows of one value, in the order of their keys; those of one key stand or fall together
    tied = able.where(left & (F.col("gumbel") == hi)).groupBy(key).agg(F.count("*").alias("n"))
    last = None
    for r in tied.orderBy(key).toLocalIterator():
        last, need = r[key], need - r["n"]
        if need <= 0:
            break
    return Draw(hi, last)


def noisy(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """weighed rows with ``gumbel``: log weight plus noise."""
    return rows.withColumn("gumbel", F.col("log_weight") + gumbel(key, seed))


def classified(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None, seed: int = 0) -> DataFrame:
    """docs with log_weight, n_grams, gumbel and drawn; columns of these names are replaced. They are written once in the shared folder."""
    model = fit(docs, labels, key, text)
    rows = Store(spark, "draw").keep(noisy(weighed(docs.drop("gumbel", "drawn"), model, text), key, seed))
    return rows.withColumn("drawn", draw(rows, key, k).takes(key))
