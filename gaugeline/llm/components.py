"""Connected components by alternating large-star and small-star.

Both steps are a minimum per node, aggregated before the shuffle, and a join back
on the node, so a node with very many links is a skewed join that Spark can split,
never one task's list. Each round is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._store import Store


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    # e holds u > v, so the larger neighbours of a node n are the u of rows with v = n
    return e.join(least, e.v == least.n).select("u", F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    low = e.join(least, (e.u == least.n) & (e.v != least.m)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, which has none itself."""
    seen = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    bad = seen.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return bad.isEmpty()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    edges: columns a, b of one comparable type, in either direction. Loops, nulls
    and repeated links have no effect; no links, no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = store.keep(e)
    while not _is_stars(e):
        old, e = e, store.keep(_small_star(_large_star(e)))
        store.drop(old)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    return out
