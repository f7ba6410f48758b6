"""Queries: results from measurements, passes of measuring, refused concerns, wide quality rows, faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import vocab
from gaugeline.operators import capture, geometry, results, sweep
from gaugeline.plans import q_cohort, q_refusals
from gaugeline.plans import standin as st

#: What stands for an unmeasured region, one without reference, and a capture whose redness is refused.
UNSEEN, UNKNOWN, CAST = "roi_6", "roi_7", "1-URGENT"
METRICS, STAGES, REGIONS = ("quantity", "discount"), ("hair", "glasses"), ("roi_1", "roi_3")


def _measured(s, d):
    return st.facts(s, d, subject=False).withColumn("value", F.when(F.col("roi") != UNSEEN, F.col("value")))


def _refusals(s, d):
    return st.captures(s, d).where(F.col("failure") == CAST).select("image", F.lit("redness").alias("concern"), F.lit("color_cast").alias("reason"))


def _areas(s, d):
    """One row for each region: an order may have a line number twice."""
    return q_refusals._areas(s, d).groupBy("image", "roi", "anchor").agg(F.max("area").alias("area"), F.max("visibility").alias("visibility"))


def _primary(s):
    return vocab.small_table(s, "concern string,roi string", list(q_refusals.PRIMARY))


def _analysed(s, d):
    known = q_cohort._reference(s, d, q_cohort._means(s, d)).where(F.col("roi") != UNKNOWN)
    return results.analysed(st.captures(s, d), _measured(s, d), _refusals(s, d), known, st.directions(s), st.METHODS, st.FLOORS, _primary(s))


def scan_results(s, d):
    joined = [F.array_join(c, ",").alias(c) for c in ("regions", "unmeasurable_regions")]
    return _analysed(s, d).select("image", "status", "concern", "severity", *joined, "note")


def undecided_concerns(s, d):
    out = results.undecided(_measured(s, d), ["image"])
    return out.select("image", "concern", "severity", *[F.array_join(c, ",").alias(c) for c in ("measured_regions", "unmeasurable_regions")])


def refused_concerns(s, d):
    return results.refused(_refusals(s, d), _primary(s), ["image"]).withColumn("unmeasurable_regions", F.array_join("unmeasurable_regions", ","))


def retake_rows(s, d):
    return results.retakes(st.captures(s, d)).select("image", "status", F.size("regions").alias("n_regions"))


def wide_observations(s, d):
    """Orders as images, their lines as regions; faces and points by the customer's number."""
    li = st.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    areas = capture.excluded(_areas(s, d), ["image"], q_refusals.FLOORS, q_refusals.FLOOR, q_refusals.LEAST_VISIBILITY)
    regions = areas.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("roi", "visibility"))).alias("visible"), F.collect_list(F.when(F.col("unusable"), F.col("roi"))).alias("undersized"))
    rows = st.captures(s, d).join(li, "image").join(regions, "image")
    as_map = lambda **kv: F.create_map(*[x for k, c in kv.items() for x in (F.lit(k), F.col(c))])
    rows = rows.select(
        "image", (F.col("subject_id") % 4).alias("n_faces"), F.when(F.col("subject_id") % 8 == 5, 468).otherwise(478).alias("n_points"), F.col("qc_passed").alias("passed"), F.array(F.col("failure"), F.lit("blur")).alias("failures"),
        F.lit(q_refusals.ANCHOR).alias("anchor_px"), F.when(F.col("subject_id") % 3 > 0, F.col("tax")).alias("coverage"), F.lit(None).cast("string").alias("failed_stage"),
        as_map(quantity="quantity", discount="discount").alias("metrics"), as_map(hair="tax").alias("rejected"), "visible", "undersized",
    )
    out = sweep.observations(rows, list(METRICS), list(STAGES), list(REGIONS))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def least_visible(s, d):
    """The least visible of three regions, those without a line being 0."""
    seen = _areas(s, d).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("roi", "visibility"))).alias("m"))
    return seen.select("image", F.round(capture.least_visibility(F.col("m"), ("roi_1", "roi_2", "roi_3")), 6).alias("least"))


def first_faces(s, d):
    """Orders with none, one or two faces, of 468 or 478 points each."""
    points = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i + F.col("o_custkey")).cast("double").alias("x"), i.cast("double").alias("y")))
    face = points(F.when(F.col("o_orderkey") % 2 == 0, 478).otherwise(468))
    faces = F.when(F.col("o_custkey") % 3 == 0, F.slice(F.array(face), 1, 0)).when(F.col("o_custkey") % 3 == 1, F.array(face)).otherwise(F.array(face, face))
    got = st.table(s, d, "orders").select(F.col("o_orderkey").alias("image"), geometry.first_face(faces).alias("f"))
    return got.select("image", F.when(F.col("f").isNotNull(), F.size("f")).alias("n_points"), F.get("f", F.lit(0))["x"].alias("first_x"))


QUERIES = {f.__name__: f for f in (scan_results, undecided_concerns, refused_concerns, retake_rows, wide_observations, least_visible, first_faces)}

_PRIMARY_SQL = "(SELECT concern, string_agg(roi, ',' ORDER BY roi) AS rois FROM (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in q_refusals.PRIMARY) + ") v(concern, roi) GROUP BY 1)"
_BAD = f"(area < CASE roi {' '.join(f'WHEN {r!r} THEN {v}::DOUBLE' for r, v in q_refusals.FLOORS.items())} ELSE {q_refusals.FLOOR}::DOUBLE END * anchor * anchor OR visibility < {q_refusals.LEAST_VISIBILITY}::DOUBLE)"
_SHARES = ", ".join(f"coalesce(max(CASE WHEN bad THEN 0 ELSE visibility END) FILTER (roi = '{r}'), 0) AS v_{r}, coalesce(bool_or(bad AND roi = '{r}'), false)::INT AS u_{r}" for r in REGIONS)

SQL = {
    "scan_results": f"""
WITH {st.REFERENCE_SQL},
f AS (SELECT image, concern, roi, measurement, CASE WHEN roi <> '{UNSEEN}' THEN value END AS value FROM facts JOIN captures USING (image) WHERE qc_passed AND NOT (concern = 'redness' AND failure = '{CAST}')),
z AS (SELECT f.*, (f.value - r.median) / ({vocab.MAD_SCALE}::DOUBLE * r.mad + {vocab.EPS}::DOUBLE) * CASE measurement WHEN 'discount' THEN -1 ELSE 1 END AS s FROM f LEFT JOIN (SELECT * FROM reference WHERE roi <> '{UNKNOWN}') r USING (concern, roi, measurement)),
g AS (SELECT image, concern, roi, count(value) > 0 AS seen, CASE WHEN concern = 'texture' THEN median(s) ELSE max(s) END AS z, max(value) FILTER (measurement = 'quantity') AS quantity, max(value) FILTER (measurement = 'price') AS price FROM z GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN z IS NULL THEN -1 WHEN z < 0.5 THEN 0 WHEN z < 1.5 THEN 1 WHEN z < 2.5 THEN 2 ELSE 3 END AS rank, coalesce(CASE concern WHEN 'redness' THEN quantity >= 45 AND price >= 60000 WHEN 'wrinkles' THEN price >= 80000 END, false) AS strong FROM g),
a AS (SELECT image, concern, bool_or(seen AND z IS NULL) AS gap, max(rank) AS top, count(*) FILTER (rank = mx) AS n, bool_or(rank = mx AND strong) AS strong, coalesce(string_agg(roi, ',' ORDER BY roi) FILTER (rank >= 1), '') AS regions,
    coalesce(string_agg(roi, ',' ORDER BY roi) FILTER (NOT seen), '') AS unseen, string_agg(roi, ',' ORDER BY roi) AS every FROM (SELECT *, max(rank) OVER (PARTITION BY image, concern) AS mx FROM b) GROUP BY 1, 2)
SELECT image, 'analysis' AS status, concern, CASE WHEN gap OR top < 0 THEN 'unmeasurable' ELSE (['not_detected', 'mild', 'moderate', 'high'])[(CASE WHEN top <= 0 OR n >= 2 OR strong THEN top ELSE top - 1 END) + 1] END AS severity,
  CASE WHEN gap THEN '' ELSE regions END AS regions, CASE WHEN gap THEN every ELSE unseen END AS unmeasurable_regions, CASE WHEN gap THEN '{results.NO_REFERENCE}' END AS note FROM a
UNION ALL SELECT image, 'analysis', 'redness', 'unmeasurable', '', rois, 'color_cast' FROM captures, {_PRIMARY_SQL} p WHERE qc_passed AND failure = '{CAST}' AND p.concern = 'redness'
UNION ALL SELECT image, 'retake_required', NULL, NULL, '', '', NULL FROM captures WHERE NOT qc_passed""",
    "undecided_concerns": f"""
WITH {st.REGIONS_SQL} SELECT image, concern, 'unmeasurable' AS severity, coalesce(string_agg(roi, ',' ORDER BY roi) FILTER (roi <> '{UNSEEN}'), '') AS measured_regions,
  coalesce(string_agg(roi, ',' ORDER BY roi) FILTER (roi = '{UNSEEN}'), '') AS unmeasurable_regions FROM regions GROUP BY 1, 2""",
    "refused_concerns": f"WITH {st.CAPTURES_SQL} SELECT image, concern, 'unmeasurable' AS severity, rois AS unmeasurable_regions, 'color_cast' AS note FROM captures, {_PRIMARY_SQL} p WHERE failure = '{CAST}' AND concern = 'redness'",
    "retake_rows": f"WITH {st.CAPTURES_SQL} SELECT image, 'retake_required' AS status, 0 AS n_regions FROM captures WHERE NOT qc_passed",
    "wide_observations": f"""
WITH {st.CAPTURES_SQL}, {q_refusals._AREAS}, li AS (SELECT l_orderkey AS image, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
c AS (SELECT image, subject_id % 4 AS n_faces, subject_id % 8 = 5 AS short, subject_id % 4 > 0 AND subject_id % 8 <> 5 AS seen, qc_passed, failure, CASE WHEN subject_id % 3 > 0 THEN tax ELSE 0 END AS coverage, quantity, discount, tax FROM captures JOIN li USING (image))
SELECT image, n_faces, seen AND qc_passed AS passed, CASE WHEN n_faces > 0 AND short THEN 'no_iris_landmarks' ELSE failure || '|blur' END AS failures, CASE WHEN seen THEN {q_refusals.ANCHOR}::DOUBLE END AS anchor_px,
  CASE WHEN seen THEN round(coverage, 6) END AS mask_coverage_frac_of_face, CASE WHEN seen THEN '' END AS mask_failed_stage, CASE WHEN n_faces = 0 OR seen THEN round(quantity, 6) END AS quantity, CASE WHEN n_faces = 0 OR seen THEN round(discount, 6) END AS discount,
  CASE WHEN seen THEN round(tax, 6) END AS reject_hair, CASE WHEN seen THEN 0.0::DOUBLE END AS reject_glasses, {", ".join(f"CASE WHEN seen THEN round(v_{r}, 6) END AS visible_{r}, CASE WHEN seen THEN u_{r} END AS undersized_{r}" for r in REGIONS)}
FROM c JOIN (SELECT image, {_SHARES} FROM (SELECT *, {_BAD} AS bad FROM (SELECT image, roi, anchor, max(area) AS area, max(visibility) AS visibility FROM a GROUP BY 1, 2, 3)) GROUP BY 1) USING (image)""",
    "least_visible": f"WITH {q_refusals._AREAS}, l AS (SELECT image, {', '.join(f'coalesce(max(visibility) FILTER (roi = {r!r}), 0) AS r{i}' for i, r in enumerate(('roi_1', 'roi_2', 'roi_3')))} FROM a GROUP BY 1) SELECT image, round(least(r0, r1, r2), 6) AS least FROM l",
    "first_faces": "SELECT o_orderkey AS image, CASE WHEN ok THEN 478 END AS n_points, CASE WHEN ok THEN o_custkey + 1.0::DOUBLE END AS first_x FROM (SELECT *, o_custkey % 3 > 0 AND o_orderkey % 2 = 0 AS ok FROM orders)",
}
