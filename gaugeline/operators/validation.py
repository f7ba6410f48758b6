"""Release validation: groups of captures, agreement, variation, availability, rejection, fairness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import robust, vocab
from gaugeline.operators import cohort

GROUP = ["subject_id", "session"]


def groups(captures: DataFrame, least: int = 2) -> DataFrame:
    """(image, subject_id, session, n_captures) of subject-sessions with enough captures.

    A blank subject is in no group; a blank session counts as one session '_'.
    """
    session = F.coalesce(F.when(F.trim("session_id") != "", F.col("session_id")), F.lit("_"))
    rows = captures.where(F.trim(F.col("subject_id").cast("string")) != "").select("image", "subject_id", session.alias("session"))
    n = rows.groupBy(*GROUP).agg(F.count("*").alias("n_captures")).where(F.col("n_captures") >= least)
    return rows.join(n, GROUP)


def ordinal_agreement(grouped: DataFrame, severities: DataFrame) -> DataFrame:
    """(concern, agreed, comparable): groups whose captures all have an ordinal band, and those of them with one band.

    A capture without a severity for the concern, or one outside the order, makes its group not comparable.
    """
    s = severities.where(vocab.is_ordinal(F.col("severity")))
    per = grouped.join(s, "image").groupBy(*GROUP, "concern").agg(F.count_distinct("image").alias("n"), F.max("n_captures").alias("n_captures"), F.min("severity").alias("lo"), F.max("severity").alias("hi"))
    comparable = F.col("n") == F.col("n_captures")
    return per.groupBy("concern").agg(F.count_if(comparable & (F.col("lo") == F.col("hi"))).alias("agreed"), F.count_if(comparable).alias("comparable"))


def metric_cvs(grouped: DataFrame, facts: DataFrame) -> DataFrame:
    """(subject_id, session, concern, roi, measurement, cv) for what every capture of a group measured; cv is null for a zero mean."""
    rows = grouped.join(facts.select("image", *cohort.FACT_KEY, "value"), "image")
    per = rows.groupBy(*GROUP, *cohort.FACT_KEY).agg(F.count_distinct("image").alias("n"), F.max("n_captures").alias("n_captures"), robust.variation("value").alias("cv"))
    return per.where("n = n_captures").drop("n", "n_captures")


def roi_availability(grouped: DataFrame, facts: DataFrame, concerns: list[str]) -> DataFrame:
    """(concern, agreed, examined): groups whose captures measured the same regions; groups that measured none are not examined."""
    names = F.explode(F.array(*map(F.lit, concerns))).alias("concern")
    every = grouped.select("image", *GROUP, names)
    sets = facts.groupBy("image", "concern").agg(F.array_join(F.sort_array(F.collect_set("roi")), ",").alias("rois"))
    per = every.join(sets, ["image", "concern"], "left").fillna({"rois": ""}).groupBy(*GROUP, "concern").agg(F.min("rois").alias("lo"), F.max("rois").alias("hi"))
    return per.where("hi <> ''").groupBy("concern").agg(F.count_if(F.col("lo") == F.col("hi")).alias("agreed"), F.count("*").alias("examined"))


def rejection(captures: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_images, n_subjects, rejection_rate, gated)"""
    out = captures.groupBy(*by).agg(F.count("*").alias("n_images"), F.count_distinct("subject_id").alias("n_subjects"), F.avg((~F.col("qc_passed")).cast("double")).alias("rejection_rate"))
    return out.withColumn("gated", F.col("n_images") >= vocab.MIN_SLICE)


def severity_tally(severities: DataFrame, captures: DataFrame, column: str, concerns: list[str]) -> DataFrame:
    """(value, concern, one count for each band, and not_analysed) over captures of a slice."""
    names = F.explode(F.array(*map(F.lit, concerns))).alias("concern")
    every = captures.where(F.trim(column) != "").select("image", F.trim(column).alias("value"), names)
    bands = [*vocab.BANDS, *vocab.OUTSIDE, "not_analysed"]
    rows = every.join(severities, ["image", "concern"], "left").fillna({"severity": "not_analysed"})
    return rows.groupBy("value", "concern").agg(*[F.count_if(F.col("severity") == b).alias(b) for b in bands])


def fairness(captures: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, status): whether each required slice has two values at least."""
    rows = cohort.sliced(captures, columns, []).groupBy("column").agg(F.count_distinct("value").alias("n_values"))
    every = captures.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    out = every.join(rows, "column", "left").fillna({"n_values": 0})
    return out.withColumn("status", F.when(F.col("n_values") >= vocab.GATES["fairness_values"], "pass").otherwise("not_evaluated"))


def gate(df: DataFrame, name: Column, value: Column, bound: float, higher: bool) -> DataFrame:
    """(name, status, value, bound) rows of a gate."""
    return df.select(name.alias("name"), cohort.verdict(value, bound, higher).alias("status"), value.alias("value"), F.lit(bound).alias("bound"))


def release_ok(gates: DataFrame, allow_not_evaluated: bool = False) -> bool:
    """Whether no gate fails, nor stays unevaluated unless that is allowed."""
    bad = ["fail"] if allow_not_evaluated else ["fail", "not_evaluated"]
    return gates.where(F.col("status").isin(bad)).isEmpty()


def caveats(run_mode: str, regions_verified: bool, calibrated: bool, has_session_column: bool) -> list[str]:
    """What keeps a report from being release evidence, in the order in which it is read."""
    return [
        text
        for holds, text in (
            (run_mode != "production", f"run mode is {run_mode}"),
            (not regions_verified, "regions are not verified"),
            (not calibrated, "severity is not calibrated"),
            (not has_session_column, "captures of a subject are one session"),
        )
        if holds
    ]


def never_fired(fired: DataFrame, column: str, checks: list[str]) -> DataFrame:
    """Checks that no row has."""
    every = fired.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, checks))).alias(column))
    return every.join(fired.select(column).distinct(), column, "left_anti")


def first_by_hash(df: DataFrame, content: str, order: str) -> DataFrame:
    """df without later copies of equal content: the first by order stays. Null content has no copy."""
    h = F.sha2(F.col(content).cast("binary"), 256)
    first = df.where(F.col(content).isNotNull()).groupBy(h.alias("__h")).agg(F.min(order).alias("__first"))
    kept = df.withColumn("__h", h).join(first, "__h").where(F.col(order) == F.col("__first")).drop("__h", "__first")
    return kept.unionByName(df.where(F.col(content).isNull()))


def ranked_candidates(df: DataFrame, content: str, path: str, score: str) -> DataFrame:
    """Distinct contents (first by path) from the best score down, ties by path, with ``position``."""
    return first_by_hash(df, content, path).withColumn("position", F.row_number().over(Window.orderBy(F.desc(score), path)))
