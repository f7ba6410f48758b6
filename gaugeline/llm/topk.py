"""Exact top-k search by distributed histogram selection.

Vectors become integers, so scores are exact. Vectors and queries are packed into blocks
of bounded size, and every query block meets every vector block of its length. Each pass scores all of
these pairs of blocks and sends, by query, a histogram of the scores in the range that
still holds the k-th best: the ranges start at the largest possible score and shrink by
BINS each pass, until a bin is one score wide. A block's own k-th best score bounds the
global one from below, so a block sends only the bins from there up: k at most for each
query. The last pass sends the scores above each query's k-th value, and of those equal
to it the smallest ids that are still needed, and ranks them.

Vector blocks stay where they are. Query blocks go to them in chunks of at most CHUNK_BYTES, counted
from the number and length of a chunk's queries, so what is broadcast does not grow; each chunk is
searched on its own and its results are written.

Defined results. A vector that is null, or holds a null or non-finite component, takes no
part, nor does a row without id; vectors of another length than a query's are not compared
to it. Every finite component counts, however large: where products may leave 53 or 63 bits, blocks are scored by
integers of any size. A score beyond a 64-bit number is the nearest one, +-(2**63 - 1), so such
scores are equal to each other. A row with the query's id is its own and no candidate. Repeated rows of the same id
and vector are one query, but as candidates each counts. Ties go to the smaller id. With
fewer candidates than k, all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._store import Store

#: Rows of a block of queries and of a block of vectors.
QUERY_ROWS, VECTOR_ROWS = 512, 4096
#: Bins of a histogram, and so the factor by which a pass narrows a range.
BINS = 4096
#: Bytes of the queries of a chunk, which are broadcast together.
CHUNK_BYTES = 32 << 20
#: The largest score.
MOST = 2**63 - 1

_BLOCK = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType())])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, components as doubles."""
    x = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("v")).where(F.coalesce(whole, F.lit(False)))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, ids, data): rows (id, v) of one length in blocks of at most size rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int, n: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in held[dim])
            held[dim] = ([ids[n:]], [data[n:]])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[:n].tobytes()], pa.binary()), pa.array([data[:n].tobytes()], pa.binary())], names=_BLOCK.names)

        for b in batches:
            col = b.column(1)
            ids, dims = b.column(0).to_numpy(), np.asarray(col.value_lengths())
            flat = col.flatten().to_numpy()
            ends = np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                kept = held.setdefault(dim, ([], []))
                kept[0].append(ids[at])
                kept[1].append(data)
                while sum(map(len, held[dim][0])) >= size:
                    yield out(dim, size)
        for dim in held:
            if n := sum(map(len, held[dim][0])):
                yield out(dim, n)

    return rows.mapInArrow(run, _BLOCK)


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: doubles, which hold them exactly, or Python integers where scaling passes the largest double."""
    with np.errstate(over="ignore"):
        out = np.floor(v * float(scale))
    if np.isfinite(out).all() and scale & (scale - 1) == 0:
        return out
    return np.array([math.floor(Fraction(x) * scale) for x in v.ravel().tolist()], object).reshape(v.shape)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of scaled vectors as 64-bit integers: by doubles or 64-bit integers where these are exact, else by integers of any size."""
    reach = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    if reach < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if reach <= MOST:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    whole = [np.array([int(x) for x in y.ravel().tolist()], object).reshape(y.shape) for y in (q, v)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def query_blocks(queries: DataFrame, n: int, chunks: int) -> DataFrame:
    """(chunk, qb, qdim, qids, qdata): the distinct queries in n blocks, more where lengths differ."""
    rows = queries.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("qb"), F.size("v").alias("qdim"), "id", "v")
    lists = rows.groupBy("qb", "qdim").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("s"))  # about QUERY_ROWS entries
    return lists.select((F.col("qb") % chunks).alias("chunk"), "qb", "qdim", F.col("s.id").alias("qids"), F.flatten("s.v").alias("qdata"))


def _pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Each block of vectors with each block of a chunk's queries of its length."""
    return vectors.withColumnRenamed("dim", "qdim").join(F.broadcast(queries), "qdim")  # CHUNK_BYTES


def _each(b: pa.RecordBatch, scale: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """qb, dim, ids, vectors, query ids, queries, lower ends, needs of each pair of blocks."""
    for k in range(b.num_rows):
        dim = b.column("qdim")[k].as_py()
        ids = np.frombuffer(b.column("ids")[k].as_py(), np.int64)
        v = scaled(np.frombuffer(b.column("data")[k].as_py(), np.float64).reshape(len(ids), dim), scale)
        qids, qdata, lo, need = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("qids", "qdata", "lo", "need"))
        yield b.column("qb")[k].as_py(), dim, ids, v, qids, scaled(qdata.reshape(len(qids), dim), scale), lo, need


def _histograms(pairs: DataFrame, k: int, scale: int, width: int, bins: int) -> DataFrame:
    """(qb, qdim, q, bin, n): by query, the scores in each bin of its range, from the block's own k-th best up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qb, dim, ids, v, qids, q, lo, _ in _each(b, scale):
                s = scores(q, v)
                # a distance from the lower end can take all 64 bits
                up = (s.view(np.uint64) - lo[:, None].view(np.uint64)) // np.uint64(width)
                at = np.where(up < np.uint64(bins), up, np.uint64(0)).astype(np.int64)
                at[(ids[None, :] == qids[:, None]) | (s < lo[:, None]) | (up >= np.uint64(bins))] = -1
                m = min(k, at.shape[1])
                floor = np.partition(at, at.shape[1] - m, axis=1)[:, at.shape[1] - m]
                row, col = np.nonzero(at >= np.maximum(floor, 0)[:, None])
                cell, n = np.unique(row * bins + at[row, col], return_counts=True)
                cols = [np.full(len(cell), qb, np.int32), np.full(len(cell), dim, np.int32), (cell // bins).astype(np.int32), (cell % bins).astype(np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qb", "qdim", "q", "bin", "n"])

    return pairs.mapInArrow(run, "qb int, qdim int, q int, bin int, n long")


def _candidates(pairs: DataFrame, scale: int) -> DataFrame:
    """(qb, qdim, q, query_id, vec_id, score): scores above each query's k-th value, and the first ids of those equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qb, dim, ids, v, qids, q, lo, need in _each(b, scale):
                order = np.argsort(ids, kind="stable")
                ids, s = ids[order], scores(q, v[order])
                other = ids[None, :] != qids[:, None]
                tied = (s == lo[:, None]) & other
                tied &= np.cumsum(tied, axis=1) <= need[:, None]
                row, col = np.nonzero(((s > lo[:, None]) & other) | tied)
                cols = [np.full(len(row), qb, np.int32), np.full(len(row), dim, np.int32), row.astype(np.int32), qids[row], ids[col], s[row, col]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qb", "qdim", "q", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "qb int, qdim int, q int, query_id long, vec_id long, score long")


_WIDE = "decimal(38,0)"


def _narrowed(hist: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """blocks with each query's range cut to the bin that holds its k-th best score, and the number still needed from there.

    With fewer scores than needed a range keeps its lower end, which is below all of them.
    """
    key = ["qb", "qdim", "q"]
    sums = hist.groupBy(*key, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows at most
    run = sums.withColumn("upto", F.sum("n").over(w)).withColumn("above", F.col("upto") - F.col("n"))
    every = blocks.select("qb", "qdim", F.posexplode(F.arrays_zip("lo", "need")).alias("q", "x")).select(*key, "x.lo", "x.need")
    hit = run.join(every, key).where("above < need and upto >= need").select(*key, "bin", "above")
    now = every.join(hit, key, "left").select(*key, (F.col("lo").cast(_WIDE) + F.coalesce("bin", F.lit(0)).cast(_WIDE) * F.lit(width).cast(_WIDE)).cast("long").alias("lo"), (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"))
    lists = now.groupBy("qb", "qdim").agg(F.sort_array(F.collect_list(F.struct("q", "lo", "need"))).alias("s"))  # an entry for each query of the block
    return blocks.drop("lo", "need").join(lists.select("qb", "qdim", F.col("s.lo").alias("lo"), F.col("s.need").alias("need")), ["qb", "qdim"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors; queries has the same columns as vectors."""
    store = Store(vectors.sparkSession, "topk")
    asked = store.keep(usable(queries, key, vector).distinct())
    rows = usable(vectors, key, vector)
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    x = rows.agg(most, F.max(F.size("v")).alias("dim")).first()
    n_asked = asked.agg(F.count("*").alias("n"), most, F.max(F.size("v")).alias("dim")).first()
    ends = [math.ceil(Fraction(r["most"] or 0) * scale) for r in (x, n_asked)]
    reach = min((x["dim"] or 0) * ends[0] * ends[1], MOST)
    n = max(1, -(-n_asked["n"] // QUERY_ROWS))
    chunks = min(n, -(-n_asked["n"] * 8 * ((n_asked["dim"] or 0) + 3) // CHUNK_BYTES) or 1)
    packs = store.keep(packed(rows, VECTOR_ROWS))
    # each range starts below the smallest possible score
    blocks = query_blocks(asked, n, chunks)
    blocks = blocks.withColumn("lo", F.transform("qids", lambda _: F.lit(-reach - 1).cast("long"))).withColumn("need", F.transform("qids", lambda _: F.lit(k).cast("long")))
    every = store.keep(blocks)
    found = []
    for c in range(chunks):
        blocks, span = every.where(F.col("chunk") == c).drop("chunk"), 2 * reach + 2
        while span > 1:
            width = -(-span // BINS)
            hist = _histograms(_pairs(packs, blocks), k, scale, width, -(-span // width))
            blocks = store.keep(_narrowed(hist, blocks, width))
            span = width
        best = _candidates(_pairs(packs, blocks), scale)
        w = Window.partitionBy("qb", "qdim", "q").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(best if chunks == 1 else store.keep(best))
    return reduce(DataFrame.union, found)
