"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of one source stand in a seeded random order and are cut into blocks. The
schedule gives every block one slot. Time runs in rounds: in round q a source of
integer weight w takes part with w blocks, or with what it has left. In a round of L
slots, block j of a source with m blocks is released at floor(j * L / m) and due at
ceil((j + 1) * L / m); among released blocks the one due first goes first. On one
processor this order meets every deadline, so after t slots of a round each source has
had t * m / L blocks, less than one block more or less. While no source has run out,
L is the sum of the weights and the shares are the target; a source that runs out
leaves its slots to the others in proportion. Nothing is dropped or repeated.

Rounds with equal numbers of blocks have equal patterns, and there are at most two
more patterns than twice the sources, so the schedule is worked out once for each
pattern, each in a task of its own, in one row whose size depends on the weights alone, and is written. Ranks within a source
come from counts of 4,096 hash buckets for each source and a row number within a
bucket, so a source with most of the rows is spread over 4,096 windows, and the counts join the rows
where the windows have already brought them together.

Defined results. Sources that have no weight, and null sources, share the weight of
``other`` as one source. Rows with equal keys keep their number: each has a position of
its own, and their order among themselves is that of the other ordering columns, or
any, if these are equal too. A null key sorts first in its bucket. An empty table gives
no rows. Columns of docs that clash with the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm._store import Store

#: Documents in a block.
BLOCK = 64
#: Hash buckets of a source: three hexadecimal digits.
DIGITS = 3
#: Most sources and largest sum of weights, which bound the schedule.
MOST_SOURCES, MOST_WEIGHT = 512, 8192
OTHER = "\x00other"


def _checked(weights: dict[str, int], other: int) -> dict[str, int]:
    out = {**weights, OTHER: other}
    if not all(isinstance(w, int) and w > 0 for w in out.values()):
        raise ValueError("weights must be positive integers")
    if len(out) > MOST_SOURCES or sum(out.values()) > MOST_WEIGHT:
        raise ValueError(f"at most {MOST_SOURCES} sources and a sum of weights of {MOST_WEIGHT}")
    return out


def _pattern(sources: Column, length: Column) -> Column:
    """Earliest deadline first over one round: for each slot the number of the source that has it.

    sources: array of struct(m bigint, ...), the blocks of each source in the round.
    """
    m = F.transform(sources, lambda s: s["m"])
    state = F.struct(F.transform(m, lambda x: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<int>").alias("order"))

    def slot(s: Column, t: Column) -> Column:
        # due time and number of each source with a released block; the rest are null and sort out
        due = F.transform(
            F.arrays_zip(m.alias("m"), s["done"].alias("done")),
            lambda x, i: F.when((x["done"] < x["m"]) & (F.floor(x["done"] * length / F.greatest(x["m"], F.lit(1))) <= t), F.struct(F.ceil((x["done"] + 1) * length / x["m"]).alias("due"), i.alias("i"))),
        )
        return F.struct(F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"].alias("pick"), s["done"].alias("done"), s["order"].alias("order"))

    def step(s: Column, t: Column) -> Column:
        picked = slot(s, t)
        return F.struct(F.transform(picked["done"], lambda d, i: F.when(i == picked["pick"], d + 1).otherwise(d)).alias("done"), F.concat(picked["order"], F.array(picked["pick"])).alias("order"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), length - 1), state, step, lambda s: s["order"])


def schedule(counts: DataFrame, weights: dict[str, int], block: int) -> DataFrame:
    """(pool, first, last, base, length, slots): for rounds first to last of a pool, the slots of its blocks in the first of them.

    counts: (pool, n), one row for each pool at most; the result has as many rows as
    pools times patterns, whatever n is.
    """
    spark = counts.sparkSession
    pairs = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v).cast("bigint"))])
    w = spark.range(1).select(F.explode(pairs).alias("pool", "w"))
    pools = w.join(counts, "pool").select("pool", "w", F.ceil(F.col("n") / block).cast("bigint").alias("blocks"))
    one = pools.groupBy().agg(F.sort_array(F.collect_list(F.struct("pool", "w", "blocks"))).alias("pools")).where(F.size("pools") > 0)
    # a pattern changes where a source starts its last, partial round and where it has ended
    edges = F.flatten(F.transform("pools", lambda p: F.array(F.floor(p["blocks"] / p["w"]), F.ceil(p["blocks"] / p["w"]))))
    one = one.select("pools", F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), edges))).alias("edges"))
    part = one.select("pools", F.explode(F.transform(F.expr("slice(edges, 1, size(edges) - 1)"), lambda x, i: F.struct(x.alias("first"), F.element_at("edges", i + 2).alias("next")))).alias("p")).select("pools", "p.first", "p.next")
    part = part.select(
        "first",
        (F.col("next") - 1).alias("last"),
        F.transform("pools", lambda p: F.struct(p["pool"].alias("pool"), F.greatest(F.least(p["w"], p["blocks"] - F.col("first") * p["w"]), F.lit(0)).cast("bigint").alias("m"))).alias("round"),
        F.aggregate("pools", F.lit(0).cast("bigint"), lambda a, p: a + F.least(p["blocks"], F.col("first") * p["w"])).alias("base"),
    )
    part = part.withColumn("length", F.aggregate("round", F.lit(0).cast("bigint"), lambda a, p: a + p["m"])).where("length > 0")
    # each pattern is worked out once, in a task of its own, and written
    part = part.repartition(min(2 * len(weights) + 2, 64), "first").withColumn("order", _pattern(F.col("round"), F.col("length")))
    part = Store(spark, "mixing").keep(part)
    rows = part.select("first", "last", "base", "length", "order", F.posexplode("round").alias("i", "p")).where("p.m > 0")
    slots = F.filter(F.transform("order", lambda x, t: F.when(x == F.col("i"), t.cast("int"))), lambda t: t.isNotNull())
    return rows.select(F.col("p.pool").alias("pool"), "first", "last", "base", "length", F.col("p.m").alias("m"), slots.alias("slots"))


def _running(buckets: str) -> Column:
    """array of struct(bucket, before): the sum of n over the earlier buckets."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<bucket:int,before:bigint>>").alias("all"))
    step = lambda s, b: F.struct((s["at"] + b["n"]).alias("at"), F.concat(s["all"], F.array(F.struct(b["__bucket"].alias("bucket"), s["at"].alias("before")))).alias("all"))
    return F.aggregate(buckets, zero, step, lambda s: s["all"])


def _sortable(df: DataFrame) -> list[str]:
    """Short columns that can break ties between equal keys."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def mixed(docs: DataFrame, weights: dict[str, int], other: int = 1, key: str = "doc_id", source: str = "source", block: int = BLOCK, seed: str = "0") -> DataFrame:
    """docs with their place in the mixture.

    New columns: ``pool`` (the source, or null for the pooled others), ``block`` (number in
    its source), ``slot`` (the block's turn, gapless from 0), ``place`` (in the block).
    Sorting by slot and place gives the mixture.
    """
    weights = _checked(weights, other)
    known = [s for s in weights if s != OTHER]
    docs = docs.drop("pool", "block", "slot", "place")
    named = docs.withColumn("__pool", F.when(F.col(source).isin(known), F.col(source)).otherwise(F.lit(OTHER)))
    named = named.withColumn("__hash", F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit("0" * 32)))
    named = named.withColumn("__bucket", F.conv(F.substring("__hash", 1, DIGITS), 16, 10).cast("int"))

    # by pool, the rows in the buckets before each: at most 4,096 numbers for each of a bounded number of pools
    n = named.groupBy("__pool", "__bucket").agg(F.count("*").alias("n"))
    starts = n.groupBy("__pool").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("__bucket", "n"))).alias("buckets"))
    starts = starts.select("__pool", "n", F.explode(_running("buckets")).alias("b")).select("__pool", "n", F.col("b.bucket").alias("__bucket"), F.col("b.before").alias("__before"))
    starts = Store(docs.sparkSession, "mixing").keep(starts)
    plan = schedule(starts.groupBy(F.col("__pool").alias("pool")).agg(F.max("n").alias("n")), weights, block)
    plan = plan.select(F.col("pool").alias("__pool"), F.struct("first", "last", "base", "length", "m", "slots").alias("r")).groupBy("__pool").agg(F.collect_list("r").alias("__rounds"))

    w = Window.partitionBy("__pool", "__bucket").orderBy("__hash", F.col(key), *[F.col(c) for c in _sortable(docs) if c != key])
    ranked = named.withColumn("__row", F.row_number().over(w))
    ranked = ranked.join(starts.drop("n"), ["__pool", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("__rank") / block)).withColumn("place", (F.col("__rank") % block).cast("int"))
    # bounded by the limits on weights: two more patterns than twice MOST_SOURCES, MOST_WEIGHT slots of 4 bytes in each, so 34 MB
    ranked = ranked.join(F.broadcast(plan), "__pool")
    size = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])[F.col("__pool")]
    ranked = ranked.withColumn("__q", F.floor(F.col("block") / size)).withColumn("__j", F.col("block") % size)
    own = F.filter("__rounds", lambda r: (r["first"] <= F.col("__q")) & (F.col("__q") <= r["last"]))[0]
    ranked = ranked.withColumn("__r", own)
    slot = F.col("__r.base") + (F.col("__q") - F.col("__r.first")) * F.col("__r.length") + F.element_at(F.col("__r.slots"), (F.col("__j") + 1).cast("int"))
    pool = F.when(F.col("__pool") != OTHER, F.col("__pool"))
    return ranked.select(*docs.columns, pool.alias("pool"), "block", slot.alias("slot"), "place")
