"""Queries: validation statistics and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import robust, vocab
from gaugeline.operators import cohort, sweep, validation
from gaugeline.plans import standin as st
from gaugeline.plans.q_cohort import r6

G = vocab.GATES


def _grouped(s, d):
    return validation.groups(st.captures(s, d))


def session_groups(s, d):
    return _grouped(s, d).select("subject_id", "session", "n_captures").distinct()


def ordinal_agreement(s, d):
    return validation.ordinal_agreement(_grouped(s, d), st.severities(s, d))


def metric_cv(s, d):
    return validation.metric_cvs(_grouped(s, d), st.facts(s, d, subject=False)).select("subject_id", "session", "concern", "roi", "measurement", r6("cv"))


def _every_concern(s):
    return vocab.small_table(s, "concern string", [(c,) for c in st.CONCERNS])


def cv_p95_gate(s, d):
    cvs = validation.metric_cvs(_grouped(s, d), st.facts(s, d, subject=False))
    per = cvs.groupBy("concern").agg(F.count("cv").alias("n"), F.count_if(F.col("cv").isNull()).alias("undefined"), F.round(F.max("cv"), 6).alias("worst"))
    ends = robust.quantiles(cvs, ["concern"], "cv", {"value": 0.95, "median": 0.5}).select("concern", F.round("value", 6).alias("value"), F.round("median", 6).alias("median"))
    per = per.join(ends, "concern", "left")
    bounds = vocab.small_table(s, "concern string,bound double", [(c, vocab.CV_BOUNDS[c]) for c in st.CONCERNS])
    status = F.when(F.col("value").isNull(), "not_evaluated").when(F.col("value") <= F.col("bound"), "pass").otherwise("fail")
    return bounds.join(per, "concern", "left").withColumn("status", status)


def roi_availability(s, d):
    return validation.roi_availability(_grouped(s, d), st.facts(s, d, subject=False), list(st.CONCERNS))


def repeatability_gates(s, d):
    o, a = ordinal_agreement(s, d), roi_availability(s, d)
    every = _every_concern(s)
    named = lambda df, name, num, den, bound: validation.gate(every.join(df, "concern", "left").withColumn("v", F.round(F.when(F.col(den) > 0, F.col(num) / F.col(den)), 6)), F.concat(F.lit(f"{name}["), F.col("concern"), F.lit("]")), F.col("v"), bound, True)
    stability = vocab.small_table(s, "name string,status string,value double,bound double", [("candidate_map_stability", "not_evaluated", None, None)])
    return named(o, "ordinal_agreement", "agreed", "comparable", G["ordinal_agreement"]).union(named(a, "roi_availability", "agreed", "examined", G["roi_availability"])).union(stability)


def rejection_rate(s, d):
    return validation.rejection(st.captures(s, d), []).select("n_images", "n_subjects", r6("rejection_rate"))


def sliced_rejection(s, d):
    long = cohort.sliced(st.captures(s, d, slices=True), list(st.SLICES), ["subject_id", "qc_passed"])
    return validation.rejection(long, ["column", "value"]).select("column", "value", "n_images", "n_subjects", r6("rejection_rate"), "gated")


def slice_spread(s, d):
    return cohort.spread(sliced_rejection(s, d), "rejection_rate").select("column", "n_gated", r6("spread"))


def capture_gates(s, d):
    level = rejection_rate(s, d)
    worst = slice_spread(s, d).agg(F.max("spread").alias("spread"))
    return validation.gate(level, F.lit("capture_rejection_rate"), F.col("rejection_rate"), G["rejection_rate"], False).union(validation.gate(worst, F.lit("capture_rejection_slice_spread"), F.col("spread"), G["rejection_spread"], False))


def severity_pivot(s, d):
    return validation.severity_tally(st.severities(s, d), st.captures(s, d, slices=True), "segment", list(st.CONCERNS))


def fairness_coverage(s, d):
    return validation.fairness(st.captures(s, d, slices=True), [*st.SLICES, "session_id"])


def never_fired(s, d):
    return validation.never_fired(st.captures(s, d).select("failure"), "failure", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", *vocab.FAILURES])


def qc_percentiles(s, d):
    return sweep.metric_summary(st.regions(s, d), list(st.DIRECTIONS)).select("metric", "n", *[r6(f"p{round(q * 100):02d}") for q in sweep.QUANTILES])


def failure_tally(s, d):
    joined = st.captures(s, d).select(F.concat_ws("|", F.col("failure"), F.when(~F.col("qc_passed"), "rejected")).alias("failures"))
    return sweep.failure_tally(joined, "failures")


def content_dedup(s, d):
    return validation.first_by_hash(st.table(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


def manifest_match(s, d):
    """Captures with a manifest row: the subject's; the last row of an image counts."""
    manifest = st.table(s, d, "events").select(F.col("event_id").alias("row"), F.col("user_id").alias("image"), "event_type")
    last = manifest.groupBy("image").agg(F.max_by("event_type", "row").alias("event_type"))
    return st.subjects(s, d).join(last, F.col("subject_id") == F.col("image")).select("image", "segment", "event_type")


def manifest_anti(s, d):
    manifest = st.table(s, d, "events").select(F.col("user_id").alias("subject_id"))
    return st.subjects(s, d).join(manifest, "subject_id", "left_anti").select("subject_id")


def worst_cv(s, d):
    cvs = validation.metric_cvs(_grouped(s, d), st.facts(s, d, subject=False)).where("cv is not null")
    top = F.max(F.struct(F.round("cv", 6).alias("cv"), (-F.col("subject_id")).alias("s"), "session", "roi", "measurement")).alias("t")
    return cvs.groupBy("concern").agg(top).select("concern", "t.cv", (-F.col("t.s")).alias("subject_id"), "t.session", "t.roi", "t.measurement")


QUERIES = {f.__name__: f for f in (session_groups, ordinal_agreement, metric_cv, cv_p95_gate, roi_availability, repeatability_gates, rejection_rate, sliced_rejection, slice_spread, capture_gates, severity_pivot, fairness_coverage, never_fired, qc_percentiles, failure_tally, content_dedup, manifest_match, manifest_anti, worst_cv)}

_GROUPED = "grouped AS (SELECT c.image, c.subject_id, coalesce(nullif(trim(session_id), ''), '_') AS session, count(*) OVER (PARTITION BY subject_id, coalesce(nullif(trim(session_id), ''), '_')) AS n_captures FROM captures c QUALIFY n_captures >= 2)"
_ORD = f"""{st.SEVERITIES_SQL}, {_GROUPED},
ordinal AS (
  SELECT concern, count(*) FILTER (n = nc AND lo = hi) AS agreed, count(*) FILTER (n = nc) AS comparable FROM (
    SELECT subject_id, session, concern, count(DISTINCT image) AS n, max(n_captures) AS nc, min(severity) AS lo, max(severity) AS hi
    FROM grouped JOIN severities USING (image) WHERE severity <> 'unmeasurable' GROUP BY 1, 2, 3) GROUP BY 1),
available AS (
  SELECT concern, count(*) FILTER (lo = hi) AS agreed, count(*) AS examined FROM (
    SELECT subject_id, session, concern, min(rois) AS lo, max(rois) AS hi FROM (
      SELECT g.subject_id, g.session, c.concern, coalesce(r.rois, '') AS rois FROM grouped g, (VALUES ('redness'), ('texture'), ('wrinkles')) c(concern)
      LEFT JOIN (SELECT image, concern, string_agg(DISTINCT roi, ',' ORDER BY roi) AS rois FROM regions GROUP BY 1, 2) r ON r.image = g.image AND r.concern = c.concern) GROUP BY 1, 2, 3)
  WHERE hi <> '' GROUP BY 1)"""
_CV = f"""{st.FACTS_SQL}, {_GROUPED},
cvs AS (
  SELECT subject_id, session, concern, roi, measurement, CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / abs(avg(value)) END AS cv
  FROM (SELECT g.subject_id, g.session, g.n_captures, f.image, f.concern, f.roi, f.measurement, f.value FROM grouped g JOIN facts f USING (image))
  GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT image) = max(n_captures))"""
_SLICED = f"""{st.CAPTURES_SQL}, {st.SUBJECTS_SQL},
sliced AS (
  SELECT col AS "column", value, count(*) AS n_images, count(DISTINCT subject_id) AS n_subjects, round(avg((NOT qc_passed)::INT), 6) AS rejection_rate, count(*) >= 5 AS gated
  FROM (SELECT c.subject_id, c.qc_passed, k.col, trim(CASE k.col WHEN 'segment' THEN s.segment ELSE s.nation END) AS value FROM captures c JOIN subjects s USING (subject_id), (VALUES ('segment'), ('nation')) k(col))
  WHERE value <> '' GROUP BY 1, 2),
spreads AS (SELECT "column", count(*) FILTER (gated) AS n_gated, CASE WHEN count(*) FILTER (gated) >= 2 THEN round(max(rejection_rate) FILTER (gated) - min(rejection_rate) FILTER (gated), 6) END AS spread FROM sliced GROUP BY 1)"""
_GATE = lambda v, b, op: f"CASE WHEN {v} IS NULL THEN 'not_evaluated' WHEN {v} {op} {b} THEN 'pass' ELSE 'fail' END"
_BANDS = [*vocab.BANDS, *vocab.OUTSIDE, "not_analysed"]

SQL = {
    "session_groups": f"WITH {st.CAPTURES_SQL}, {_GROUPED} SELECT DISTINCT subject_id, session, n_captures FROM grouped",
    "ordinal_agreement": f"WITH {_ORD} SELECT * FROM ordinal",
    "metric_cv": f"WITH {_CV} SELECT subject_id, session, concern, roi, measurement, round(cv, 6) AS cv FROM cvs",
    "cv_p95_gate": f"""
WITH {_CV}, per AS (SELECT concern, round(quantile_cont(cv, 0.95), 6) AS value, round(quantile_cont(cv, 0.5), 6) AS median, count(cv) AS n, count(*) FILTER (cv IS NULL) AS undefined, round(max(cv), 6) AS worst FROM cvs GROUP BY 1)
SELECT b.concern, bound, value, median, n, undefined, worst, {_GATE("value", "bound", "<=")} AS status
FROM (VALUES {", ".join(f"('{c}', {vocab.CV_BOUNDS[c]}::DOUBLE)" for c in st.CONCERNS)}) b(concern, bound) LEFT JOIN per USING (concern)""",
    "roi_availability": f"WITH {_ORD} SELECT * FROM available",
    "repeatability_gates": f"""
WITH {_ORD}, every AS (SELECT * FROM (VALUES ('redness'), ('texture'), ('wrinkles')) c(concern)),
o AS (SELECT concern, round(CASE WHEN comparable > 0 THEN agreed / comparable END, 6) AS v FROM every LEFT JOIN ordinal USING (concern)),
a AS (SELECT concern, round(CASE WHEN examined > 0 THEN agreed / examined END, 6) AS v FROM every LEFT JOIN available USING (concern))
SELECT 'ordinal_agreement[' || concern || ']' AS name, {_GATE("v", "0.9", ">=")} AS status, v AS value, 0.9::DOUBLE AS bound FROM o
UNION ALL SELECT 'roi_availability[' || concern || ']', {_GATE("v", "0.9", ">=")}, v, 0.9 FROM a
UNION ALL SELECT 'candidate_map_stability', 'not_evaluated', NULL, NULL""",
    "rejection_rate": f"WITH {st.CAPTURES_SQL} SELECT count(*) AS n_images, count(DISTINCT subject_id) AS n_subjects, round(avg((NOT qc_passed)::INT), 6) AS rejection_rate FROM captures",
    "sliced_rejection": f"WITH {_SLICED} SELECT * FROM sliced",
    "slice_spread": f"WITH {_SLICED} SELECT * FROM spreads",
    "capture_gates": f"""
WITH {_SLICED}, level AS (SELECT round(avg((NOT qc_passed)::INT), 6) AS v FROM captures), worst AS (SELECT max(spread) AS v FROM spreads)
SELECT 'capture_rejection_rate' AS name, {_GATE("v", "0.35", "<=")} AS status, v AS value, 0.35::DOUBLE AS bound FROM level
UNION ALL SELECT 'capture_rejection_slice_spread', {_GATE("v", "0.2", "<=")}, v, 0.2 FROM worst""",
    "severity_pivot": f"""
WITH {st.SEVERITIES_SQL}, {st.SUBJECTS_SQL}
SELECT trim(s.segment) AS value, k.concern, {", ".join(f"count(*) FILTER (coalesce(v.severity, 'not_analysed') = '{b}') AS {b}" for b in _BANDS)}
FROM captures c JOIN subjects s USING (subject_id), (VALUES ('redness'), ('texture'), ('wrinkles')) k(concern) LEFT JOIN severities v ON v.image = c.image AND v.concern = k.concern
WHERE trim(s.segment) <> '' GROUP BY 1, 2""",
    "fairness_coverage": f"""
WITH {st.CAPTURES_SQL}, {st.SUBJECTS_SQL}
SELECT k.col AS "column", count(DISTINCT nullif(trim(CASE k.col WHEN 'segment' THEN segment WHEN 'nation' THEN nation ELSE session_id END), '')) AS n_values,
  CASE WHEN count(DISTINCT nullif(trim(CASE k.col WHEN 'segment' THEN segment WHEN 'nation' THEN nation ELSE session_id END), '')) >= 2 THEN 'pass' ELSE 'not_evaluated' END AS status
FROM captures JOIN subjects USING (subject_id), (VALUES ('segment'), ('nation'), ('session_id')) k(col) GROUP BY 1""",
    "never_fired": f"""SELECT failure FROM (VALUES {", ".join(f"('{x}')" for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", *vocab.FAILURES))}) v(failure) WHERE failure NOT IN (SELECT o_orderpriority FROM orders)""",
    "qc_percentiles": f"""
WITH {st.REGIONS_SQL}, l AS (SELECT 'quantity' AS metric, quantity AS v FROM regions UNION ALL SELECT 'price', price FROM regions UNION ALL SELECT 'discount', discount FROM regions)
SELECT metric, count(*) AS n, {", ".join(f"round(quantile_cont(v, {q}), 6) AS p{round(q * 100):02d}" for q in sweep.QUANTILES)} FROM l WHERE v IS NOT NULL GROUP BY 1""",
    "failure_tally": f"""
WITH {st.CAPTURES_SQL} SELECT failure, count(*) AS n FROM (SELECT failure FROM captures UNION ALL SELECT 'rejected' FROM captures WHERE NOT qc_passed) WHERE failure <> '' GROUP BY 1""",
    "content_dedup": "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text",
    "manifest_match": f"""
WITH {st.SUBJECTS_SQL}, last AS (SELECT user_id AS image, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1)
SELECT image, segment, event_type FROM subjects JOIN last ON subject_id = image""",
    "manifest_anti": f"WITH {st.SUBJECTS_SQL} SELECT subject_id FROM subjects WHERE subject_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
    "worst_cv": f"""
WITH {_CV}
SELECT concern, cv, subject_id, session, roi, measurement FROM (
  SELECT concern, round(cv, 6) AS cv, subject_id, session, roi, measurement, row_number() OVER (PARTITION BY concern ORDER BY round(cv, 6) DESC, subject_id, session DESC, roi DESC, measurement DESC) AS r FROM cvs WHERE cv IS NOT NULL) WHERE r = 1""",
}
