"""Cohorts: subject means, the split, reference statistics, cut-points and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import robust, vocab

FACT_KEY = ["concern", "roi", "measurement"]


def subject_means(facts: DataFrame) -> DataFrame:
    """(subject_id, concern, roi, measurement, value, n): the mean over a subject's captures."""
    return facts.groupBy("subject_id", *FACT_KEY).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def split(subject: Column, salt: str, holdout: float = vocab.HOLDOUT) -> Column:
    """'holdout' or 'train' by the first 32 bits of a salted digest of the subject."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), subject.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(u < holdout, "holdout").otherwise("train")


def reference_stats(train: DataFrame, floor: int = vocab.COHORT_FLOOR) -> DataFrame:
    """(concern, roi, measurement, median, mad, n_subjects, calibrated) over subject means; values stand even below the floor."""
    stats = robust.medians_and_mads(train, FACT_KEY, "value")
    n = train.groupBy("concern").agg(F.count_distinct("subject_id").alias("n_subjects"))
    return stats.join(F.broadcast(n), "concern").withColumn("calibrated", F.col("n_subjects") >= floor)


def majority(votes: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """(by..., label, n, n_labels): the most frequent label; of equals the one met first in order."""
    first = F.min(F.struct(*order)).alias("first")
    n = votes.groupBy(*by, label).agg(F.count("*").alias("n"), first)
    w = Window.partitionBy(*by)
    top = n.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "first")), "n_labels": F.count("*").over(w)})
    return top.where("r = 1").select(*by, label, "n", "n_labels")


def samples(labels: DataFrame, z: DataFrame) -> DataFrame:
    """(subject_id, concern, roi, z, label): a label with its region's value, where every measurement has a reference."""
    return labels.join(z.where("z is not null"), ["subject_id", "concern", "roi"])


def evaluated(rows: DataFrame, by: list[str], predicted: str = "predicted", label: str = "label") -> DataFrame:
    """(by..., n, exact, adjacent): agreement, and agreement within one rank; null, not 0, for no rows."""
    gap = F.abs(vocab.rank(F.col(predicted)) - vocab.rank(F.col(label)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("adjacent"))


def fitted_cuts(rows: DataFrame, by: list[str], z: str = "z", label: str = "label") -> DataFrame:
    """(by..., n, misclassified, t0, t1, t2, fitted): cuts between four bands in fixed order with the fewest misclassified rows.

    With C_b(i) rows of band b among the first i, cuts i <= j <= k classify
    (C0-C1)(i) + (C1-C2)(j) + (C2-C3)(k) rows rightly, up to a constant, so two running
    maxima over the sorted rows solve it; of equal cuts the leftmost win, from the last
    band down. Cuts are midpoints, one beyond either end. ``fitted`` is false with fewer
    than four rows or cuts that do not increase. Rows are one for each labelled subject
    and region, a group is one window.
    """
    key = [*by]
    every = Window.partitionBy(*key)
    ordered = rows.select(*key, F.col(z).cast("double").alias("z"), vocab.rank(F.col(label)).alias("r"), F.row_number().over(every.orderBy(z, label)).alias("p"))
    ordered = ordered.withColumns({"n": F.count("*").over(every), "lo": F.min("z").over(every), "hi": F.max("z").over(every), "next": F.lead("z").over(every.orderBy("p"))})
    # position 0 stands before all rows, position p behind the p-th; each has the cut that it would give
    last = F.when(F.col("p") >= F.col("n"), F.col("hi") + 1.0).otherwise((F.col("z") + F.col("next")) / 2)
    here = F.struct(F.col("p").alias("p"), F.col("r").alias("r"), last.alias("cut"))
    start = F.struct(F.lit(0).alias("p"), F.lit(None).cast("int").alias("r"), (F.col("lo") - 1.0).alias("cut"))
    a = ordered.select(*key, "n", F.explode(F.when(F.col("p") == 1, F.array(start, here)).otherwise(F.array(here))).alias("x")).select(*key, "n", "x.*")
    w = every.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = a.withColumns({f"c{b}": F.count_if(F.col("r") == b).over(w) for b in range(4)})
    # the best split so far: most right, then leftmost; cuts ride along behind the unique position
    a = a.withColumn("s1", F.max(F.struct((F.col("c0") - F.col("c1")).alias("g"), (-F.col("p")).alias("at"), F.col("cut").alias("t0"))).over(w))
    a = a.withColumn("s2", F.max(F.struct((F.col("s1.g") + F.col("c1") - F.col("c2")).alias("g"), (-F.col("p")).alias("at"), F.col("cut").alias("t1"), F.col("s1.t0").alias("t0"))).over(w))
    best = F.max(F.struct((F.col("s2.g") + F.col("c2") - F.col("c3")).alias("g"), (-F.col("p")).alias("at"), F.col("cut").alias("t2"), F.col("s2.t1").alias("t1"), F.col("s2.t0").alias("t0")))
    out = a.groupBy(*key, "n").agg(best.alias("s"), F.max("c3").alias("n3"))
    out = out.select(*key, "n", (F.col("n") - F.col("s.g") - F.col("n3")).alias("misclassified"), "s.t0", "s.t1", "s.t2")
    return out.withColumn("fitted", (F.col("n") >= 4) & (F.col("t0") < F.col("t1")) & (F.col("t1") < F.col("t2")))


def sliced(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(column, value, keep...): a row for each slice column; blank values are dropped, not a slice."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])
    return df.select(F.explode(parts).alias("s"), *keep).select("s.column", "s.value", *keep).where("value is not null and value <> ''")


def spread(slices: DataFrame, x: str, by: list[str] = ["column"]) -> DataFrame:  # noqa: B006
    """(by..., n_gated, spread): widest gap between gated values; null with fewer than two."""
    ok = F.col("gated") & F.col(x).isNotNull()
    v = F.when(ok, F.col(x))
    return slices.groupBy(*by).agg(F.count(v).alias("n_gated"), F.when(F.count(v) >= 2, F.max(v) - F.min(v)).alias("spread"))


def verdict(value: Column, bound: float, higher: bool) -> Column:
    """pass or fail, bounds included; not_evaluated for null."""
    ok = value >= bound if higher else value <= bound
    return F.when(value.isNull(), "not_evaluated").when(ok, "pass").otherwise("fail")
