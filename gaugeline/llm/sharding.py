"""Sharding by k-d tree partitioning: near-equal bytes, rows alike in metadata together.

The points are groups of equal texts, weighted by bytes. A node of the tree stands for some of the
shards and is cut along its widest dimension at the weighted quantile that splits its bytes as
its shards (the median, for an even number), until each leaf holds the target bytes of one shard. Dimensions
are the size, the source and the language; a group has the least source and language of its rows. A
coordinate is the share of all bytes that stand before a value, in 65,536 steps, so an extent is a share of the
corpus in each dimension, and extents compare: values are ordered by the logarithm of the size, or by hash.

Quantiles are found by radix selection over the whole table: a histogram of the weights by
coordinate, then, among the points on the cut, by 16 bits each of their texts' hash until one group is
left. Every pass is one aggregation, with at most 65,536 sums for each of the nodes of a level; the driver receives
one row for each node.

Points with the same coordinate are ordered by their text's hash, so a cut can fall anywhere. The one group that a
cut falls into goes whole to the nearer side if the cut's goal is then missed by SLACK of a shard's bytes at most. Otherwise, as with
copies that fill more than a shard, its rows are divided by their own hash, in the same way. So at most one group for
each cut is divided (shards - 1 in all), whatever its size, and no other. Law: ``bytes``.

Defined results. A null text has no bytes; every row counts one byte more than its
text. Null source or language is a value of its own. Null, repeated and clashing
keys have no effect but on the order of slots. An empty table gives no rows. With fewer
groups than shards some shards are empty. Of dimensions of equal width the first named is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm._store import Store

#: Bits of a histogram pass.
BITS = 16
#: By what part of a shard's bytes a cut may miss its goal to keep a group whole.
SLACK = 0.005
#: Buckets of a shard in which slots are counted.
SLOT_BUCKETS = 4096
DIMENSIONS = ("d_size", "d_source", "d_lang")


@dataclass
class Cut:
    """Where a node is cut: its dimension and goal, the digits found so far, and what is left of the goal at their place."""

    shards: int
    dim: str
    goal: float
    found: list[int]
    #: Whole groups: below the last digit or up to it; None while the search goes on.
    upto: bool | None = None
    #: Where the search has one group left, the number of digits that led to it; the digits from there on are those of its rows.
    group: int | None = None


def _digit(h: str, k: int) -> Column:
    """The k-th 16 bits of a hash."""
    return F.shiftrightunsigned(h, 64 - BITS * (k + 1)).bitwiseAND(2**BITS - 1)


def _case(values: dict[int, Column]) -> Column:
    """By node, for the few nodes of a level."""
    out = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(F.col("node") == k, v).otherwise(out)
    return out


def coordinates(points: DataFrame, store: Store) -> DataFrame:
    """points with each dimension's codes (16 bits) as the share of all bytes before them, in 2**16 steps."""
    for d in DIMENSIONS:
        sums = points.groupBy(d).agg(F.sum("size").alias("w"))
        w = Window.orderBy(d)  # 65,536 rows at most
        run = sums.select(d, F.sum("w").over(w).alias("upto"), "w", F.sum("w").over(Window.partitionBy()).alias("total"))
        share = run.select(d, F.floor((F.col("upto") - F.col("w")).cast("double") * 2**BITS / F.col("total")).alias("share"))
        points = points.join(F.broadcast(store.keep(share)), d).drop(d).withColumnRenamed("share", d)  # 65,536 rows at most
    return points


def _levels(cut: Cut) -> list[Column]:
    """The digits of a row in the order in which a node's search asks for them."""
    return [F.col(cut.dim), *[_digit(h, k) for h in ("h", "k2", "r") for k in range(64 // BITS)]]


def _at(cut: Cut) -> list[Column]:
    """The digits that ``cut.found`` speaks of: where one group is left early, the rows' digits follow."""
    every = _levels(cut)
    return every if cut.group is None else every[: cut.group] + every[1 + 2 * 64 // BITS :]


def _search(points: DataFrame, cuts: dict[int, Cut], slack: float) -> None:
    """One pass for every node whose search goes on."""
    live = {n: c for n, c in cuts.items() if c.upto is None}
    digit = _case({n: _at(c)[len(c.found)] for n, c in live.items()})
    here = F.lit(False)
    for n, c in live.items():
        own = F.col("node") == n
        for d, v in zip(_at(c), c.found, strict=False):
            own = own & (d == v)
        here = here | own
    sums = points.where(here).groupBy("node", digit.alias("digit")).agg(
        F.sum("size").alias("w"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("k2").alias("g0"), F.max("k2").alias("g1"), F.min("r").alias("r0"), F.max("r").alias("r1")
    )
    w = Window.partitionBy("node").orderBy("digit")  # at most 65,536 rows a node
    goal = F.lit(None).cast("double")
    for n, c in live.items():
        goal = F.when(F.col("node") == n, F.lit(float(c.goal))).otherwise(goal)
    run = sums.withColumn("before", F.sum("w").over(w) - F.col("w")).where(F.col("before") < goal)
    hit = run.groupBy("node").agg(F.max_by(F.struct("digit", "before", "w", "h0", "h1", "g0", "g1", "r0", "r1"), "digit").alias("x"))
    for row in hit.collect():  # one row for each node
        c, x = live[row["node"]], row["x"]
        c.found.append(x["digit"])
        c.goal -= x["before"]
        if c.group is not None:
            if x["r0"] == x["r1"] or len(c.found) == len(_at(c)):
                c.upto = 2 * c.goal > x["w"]
        elif (x["h0"], x["g0"]) == (x["h1"], x["g1"]):  # one group is left
            short, over = c.goal, x["w"] - c.goal
            if min(short, over) <= slack:
                c.upto = short > over
            else:
                c.group = len(c.found)


def _below(cut: Cut) -> Column:
    """Whether a row stands below a node's cut: smaller in the first digit that differs, and at the end as ``upto`` says."""
    below, equal = F.lit(False), F.lit(True)
    for d, v in zip(_at(cut), cut.found, strict=False):
        below, equal = below | (equal & (d < v)), equal & (d == v)
    return below | (equal & F.lit(bool(cut.upto)))


def assigned(points: DataFrame, shards: int, store: Store) -> DataFrame:
    """points (key, n, size, crc, h, k2, r, d_*) with their shard."""
    spread = [F.max(d).alias(f"hi_{d}") for d in DIMENSIONS] + [F.min(d).alias(f"lo_{d}") for d in DIMENSIONS]
    points = store.keep(points.withColumn("node", F.lit(0)))
    open_nodes = {0: shards}  # by first shard, the number of shards
    target = None
    while any(c > 1 for c in open_nodes.values()):
        nodes = points.groupBy("node").agg(F.sum("size").alias("w"), *spread).collect()  # one row for each node
        if target is None:
            target = sum(r["w"] for r in nodes) / shards
        cuts = {}
        for r in nodes:
            c = open_nodes[r["node"]]
            if c > 1:
                dim = max(DIMENSIONS, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"])  # noqa: B023
                cuts[r["node"]] = Cut(c, dim, r["w"] * (c // 2) / c, [])
        while any(c.upto is None for c in cuts.values()):
            _search(points, cuts, SLACK * target)
        node = F.col("node")
        for n, c in cuts.items():
            node = F.when(F.col("node") == n, F.when(_below(c), n).otherwise(n + c.shards // 2)).otherwise(node)
        open_nodes = {n: k for f, c in open_nodes.items() for n, k in ([(f, c // 2), (f + c // 2, c - c // 2)] if c > 1 else [(f, c)])}
        # the level's decision as a column; the few constants in it are all that the next level adds
        old, points = points, store.keep(points.withColumn("node", node.cast("int")))
        store.drop(old)
    return points.withColumnRenamed("node", "shard")


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", target_bytes: int | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row of docs; slots of a shard are gapless from 0.

    target_bytes: the bytes of a leaf, from which the number of shards follows.
    """
    store = Store(docs.sparkSession, "shards")
    code = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(2**BITS - 1)) + 1).cast("long")
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 1
    rows = docs.select(
        F.col(key).alias("key"),
        size.alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("h"),
        F.xxhash64(F.reverse(body), size).alias("k2"),
        F.least(F.floor(F.log2(size) * 1024), F.lit(2**BITS - 1)).alias("d_size"),
        code(source).alias("d_source"),
        code(lang).alias("d_lang"),
        F.monotonically_increasing_id().alias("n"),
    )
    rows = store.keep(rows.withColumn("r", F.xxhash64("h", "k2", "key", "n")))
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    if shards < 1:
        raise ValueError("at least one shard")
    group = rows.groupBy("h", "k2").agg(F.min(F.struct("d_source", "d_lang")).alias("d"))
    points = rows.drop("d_source", "d_lang").join(group, ["h", "k2"]).select("key", "n", "size", "crc", "h", "k2", "r", "d_size", "d.d_source", "d.d_lang")
    out = assigned(coordinates(store.keep(points), store), shards, store)
    # slots: rows of a bucket are numbered, buckets are offset by the counts before them
    out = store.keep(out.select("key", "n", "size", "crc", "shard", F.pmod(F.col("r"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket")))
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    w = Window.partitionBy("shard").orderBy("bucket")  # at most 4,096 rows a shard
    starts = counts.select("shard", "bucket", (F.sum("c").over(w) - F.col("c")).alias("start"))
    place = Window.partitionBy("shard", "bucket").orderBy("key", "n")
    numbered = out.withColumn("slot", F.row_number().over(place) - 1).join(starts, ["shard", "bucket"])
    return numbered.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("start")).cast("long").alias("slot"))
