"""From a capture's measurements to its result: retakes, refused concerns, concerns left undecided, and what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import vocab
from gaugeline.operators import policy

RESULT = ["image", "status", "concern", "severity", "regions", "unmeasurable_regions", "note"]
NO_REFERENCE = "no reference for the measured regions"


def _none():
    return F.array().cast("array<string>")


def undecided(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by..., concern, severity, measured_regions, unmeasurable_regions) of a pass of measuring, rows (by..., concern, roi, measurement, value).

    The severity is unmeasurable until decided. Regions without any value are unmeasurable; both lists are sorted.
    """
    per = measured.where(F.col("concern").isNotNull()).groupBy(*by, "concern", "roi").agg((F.count("value") > 0).alias("seen"))
    of = lambda p: F.sort_array(F.collect_list(F.when(p, F.col("roi"))))
    return per.groupBy(*by, "concern").agg(F.lit("unmeasurable").alias("severity"), of(F.col("seen")).alias("measured_regions"), of(~F.col("seen")).alias("unmeasurable_regions"))


def refused(refusals: DataFrame, primary: DataFrame, by: list[str]) -> DataFrame:
    """(by..., concern, severity, unmeasurable_regions, note) of rows (by..., concern, reason): every primary region, for the one reason."""
    rois = primary.groupBy("concern").agg(F.sort_array(F.collect_set("roi")).alias("unmeasurable_regions"))
    return refusals.join(F.broadcast(rois), "concern", "left").select(*by, "concern", F.lit("unmeasurable").alias("severity"), F.coalesce("unmeasurable_regions", _none()).alias("unmeasurable_regions"), F.col("reason").alias("note"))  # a fixed list


def retakes(captures: DataFrame) -> DataFrame:
    """One row without concern for each capture that quality refused; nothing about its skin is said."""
    bad = captures.where(~F.coalesce(F.col("qc_passed"), F.lit(False)))
    null = F.lit(None).cast("string")
    return bad.select("image", F.lit("retake_required").alias("status"), null.alias("concern"), null.alias("severity"), _none().alias("regions"), _none().alias("unmeasurable_regions"), null.alias("note"))


def analysed(captures: DataFrame, measured: DataFrame, refusals: DataFrame, reference: DataFrame, directions: DataFrame, methods: dict[str, str], floors: dict, primary: DataFrame) -> DataFrame:
    """(image, status, concern, severity, regions, unmeasurable_regions, note): the whole way from measurements to results.

    captures: (image, qc_passed); measured: (image, concern, roi, measurement, value); refusals: (image, concern, reason).
    A capture that did not pass has its retake row only. A refused concern is not measured. Of the others all measured regions
    need a reference, else the concern stays unmeasurable, with a note, and all its regions with it.
    """
    passed = captures.where("qc_passed").select("image")
    facts = measured.join(passed, "image").join(refusals.select("image", "concern"), ["image", "concern"], "left_anti")
    base = undecided(facts, ["image"])
    z = policy.standardized(facts.where("value is not null"), reference)
    regions = policy.combined(z, ["image"], directions, methods, raw="value")
    bands = regions.select("image", "concern", "roi", vocab.to_band(F.col("z")).alias("severity"), policy.strong(F.col("raw"), floors, F.col("concern")).alias("strong"))
    unknown = bands.groupBy("image", "concern").agg(F.bool_or(F.col("severity").isNull()).alias("unknown"))
    decided = policy.aggregated(bands, ["image"]).select("image", "concern", F.col("severity").alias("__severity"), "regions").join(unknown, ["image", "concern"])
    rows = base.join(decided, ["image", "concern"], "left")
    ok = F.coalesce(~F.col("unknown"), F.lit(False))
    out = rows.select(
        "image", F.lit("analysis").alias("status"), "concern", F.when(ok, F.col("__severity")).otherwise(F.col("severity")).alias("severity"), F.when(ok, F.col("regions")).otherwise(_none()).alias("regions"),
        F.when(F.col("unknown"), F.sort_array(F.concat("measured_regions", "unmeasurable_regions"))).otherwise(F.col("unmeasurable_regions")).alias("unmeasurable_regions"), F.when(F.col("unknown"), NO_REFERENCE).alias("note"),
    )
    gone = refused(refusals.join(passed, "image"), primary, ["image"]).withColumns({"status": F.lit("analysis"), "regions": _none()})
    return out.select(*RESULT).unionByName(gone.select(*RESULT)).unionByName(retakes(captures))


def published(results: DataFrame, headers: DataFrame, protocol: str) -> DataFrame:
    """The public view (image, status, concern, severity, regions) of results; refused whole while a concern's reference cannot be published.

    headers: (concern, header), one row for each concern.
    """
    bad = headers.select("concern", policy.publication_refusal(F.col("header"), protocol).alias("reason")).where("reason is not null").orderBy("concern").first()
    if bad:
        raise ValueError(f"{bad.concern}: {bad.reason}")
    return policy.public(results, ["image", "status"])
