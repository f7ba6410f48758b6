"""Threshold sweeps and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import robust
from gaugeline.operators import geometry

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def sweep_thresholds(samples: DataFrame, by: list[str], least: int = 5, digits: int = 1) -> DataFrame:
    """(by..., threshold, n, min_tenengrad, p50_drift, p95_drift) for each distinct rounded sharpness.

    A row counts for a threshold if its unrounded sharpness is no smaller, so each sample meets every smaller threshold of its group:
    the work is that of samples times thresholds, which the rounding bounds.
    """
    cuts = samples.select(*by, F.round("laplacian_var", digits).alias("threshold")).distinct()
    a, b = samples.alias("a"), cuts.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by] + [F.col("a.laplacian_var") >= F.col("b.threshold")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    rows = a.join(b, cond).select(*[F.col(f"b.{c}") for c in by], "b.threshold", "a.tenengrad", "a.relative_drift")
    out = rows.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.min("tenengrad").alias("min_tenengrad"), robust.percentile("relative_drift", 0.5).alias("p50_drift"), robust.percentile("relative_drift", 0.95).alias("p95_drift"))
    return out.where(F.col("n") >= least)


def recommended_floor(swept: DataFrame, by: list[str], bound: float | None) -> DataFrame:
    """(by..., floor): the smallest threshold whose 95th percentile keeps the bound; null if none does, or none is declared."""
    ok = F.lit(False) if bound is None else F.col("p95_drift") <= bound
    return swept.groupBy(*by).agg(F.min(F.when(ok, F.col("threshold"))).alias("floor"))


def metric_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, p05, p25, p50, p75, p95) over the rows that have the metric."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*").where("v is not null")
    return robust.quantiles(long, ["metric"], "v", {f"p{round(q * 100):02d}": q for q in QUANTILES})


def failure_tally(rows: DataFrame, failures: str, sep: str = "|") -> DataFrame:
    """(failure, n) of joined failure lists; blanks count for nothing."""
    return rows.select(F.explode(F.split(failures, f"\\{sep}")).alias("failure")).where("failure <> ''").groupBy("failure").agg(F.count("*").alias("n"))


def strictest(floors: DataFrame) -> DataFrame:
    """(floor): the largest of the concerns' floors; null if any concern has none, as no floor then holds for all."""
    return floors.agg(F.when(F.count("floor") == F.count("*"), F.max("floor")).alias("floor"))


def limit_index(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics (metric, ...) with the configured limit that applies, for display; null where none does."""
    names = F.create_map(*[x for m, (name, _) in limits.items() for x in (F.lit(m), F.lit(name))])
    values = F.create_map(*[x for m, (_, v) in limits.items() for x in (F.lit(m), F.lit(float(v)))])
    return metrics.withColumns({"limit_name": names[F.col("metric")], "limit": values[F.col("metric")]})


def wide(rows: DataFrame, key: str, metrics: str, names: list[str], prefix: str = "") -> DataFrame:
    """One column for each named entry of a map column; null where a row lacks it."""
    return rows.select(key, *[F.try_element_at(metrics, F.lit(n)).alias(f"{prefix}{n}") for n in names])


def observations(rows: DataFrame, metrics: list[str], stages: list[str], regions: list[str]) -> DataFrame:
    """One wide row for each image: faces, verdict, joined failures, metrics, and one column for each stage and region.

    rows: (image, n_faces, n_points, passed, failures, anchor_px, coverage, failed_stage, metrics, rejected, visible, undersized).
    Without a face, all that needs one is null, but the frame's metrics stay; a face without iris points has neither, and that for its failure.
    """
    face, full = F.col("n_faces") > 0, F.col("n_points") > geometry.IRIS[0]
    seen, no_iris = face & full, face & ~full
    share = lambda c, names, prefix: [F.when(seen, F.coalesce(F.try_element_at(c, F.lit(n)), F.lit(0.0))).alias(f"{prefix}{n}") for n in names]
    return rows.select(
        "image", "n_faces", (seen & F.col("passed")).alias("passed"), F.when(no_iris, "no_iris_landmarks").otherwise(F.array_join("failures", "|")).alias("failures"),
        F.when(seen, F.col("anchor_px")).alias("anchor_px"), F.when(seen, F.coalesce("coverage", F.lit(0.0))).alias("mask_coverage_frac_of_face"), F.when(seen, F.coalesce("failed_stage", F.lit(""))).alias("mask_failed_stage"),
        *[F.when(~no_iris, F.try_element_at("metrics", F.lit(m))).alias(m) for m in metrics],
        *share("rejected", stages, "reject_"), *share("visible", regions, "visible_"),
        *[F.when(seen, F.array_contains("undersized", r).cast("int")).alias(f"undersized_{r}") for r in regions],
    )
