"""Queries: subject means to severity, the split, references, cut-points, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import vocab
from gaugeline.operators import cohort, policy
from gaugeline.plans import standin as st


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def _means(s: SparkSession, d: str) -> DataFrame:
    return cohort.subject_means(st.facts(s, d))


def _reference(s: SparkSession, d: str, means: DataFrame) -> DataFrame:
    return cohort.reference_stats(means.where(cohort.split(F.col("subject_id"), st.SALT) == "train"))


def _z(s: SparkSession, d: str) -> DataFrame:
    means = _means(s, d)
    return policy.standardized(means, _reference(s, d, means))


def _bands(s: SparkSession, d: str) -> DataFrame:
    z = _z(s, d)
    rows = policy.combined(z, ["subject_id"], st.directions(s), st.METHODS, raw="value")
    return rows.select("subject_id", "concern", "roi", "z", vocab.to_band(F.col("z")).alias("severity"), policy.strong(F.col("raw"), st.FLOORS, F.col("concern")).alias("strong"))


def subject_means(s, d):
    return _means(s, d).select("subject_id", "concern", "roi", "measurement", r6("value"), "n")


def subject_split(s, d):
    return st.subjects(s, d).select("subject_id", cohort.split(F.col("subject_id"), st.SALT).alias("split"))


def reference_stats(s, d):
    return _reference(s, d, _means(s, d)).select("concern", "roi", "measurement", r6("median"), r6("mad"), "n_subjects", "calibrated")


def zref_long(s, d):
    return _z(s, d).select("subject_id", "concern", "roi", "measurement", r6("z_ref"))


def roi_band(s, d):
    return _bands(s, d).select("subject_id", "concern", "roi", r6("z"), "severity", "strong")


def concern_severity(s, d):
    out = policy.aggregated(_bands(s, d), ["subject_id"])
    return out.select("subject_id", "concern", "severity", F.array_join("regions", ",").alias("regions"), "n_at_max", "demoted")


def public_view(s, d):
    out = policy.public(policy.aggregated(_bands(s, d), ["subject_id"]), ["subject_id"])
    return out.select("subject_id", "concern", "severity", F.array_join("regions", ",").alias("regions"))


def _voted(s, d):
    """Three raters' labels of a subject's concern, by its mean quantity and the line's flags."""
    v = st.table(s, d, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("label"), F.col("event_id").alias("at"))
    return v


def majority_vote(s, d):
    return cohort.majority(_voted(s, d), ["subject_id"], "label", ["at"])


def _samples(s, d):
    """A region's value with a label: the band of the subject's mean quantity there, in quarters of its range."""
    b = _bands(s, d).where("z is not null").select("subject_id", "concern", "roi", "z")
    q = _means(s, d).where("measurement = 'quantity'").select("subject_id", "concern", "roi", F.round("value", 6).alias("q"))
    label = F.when(F.col("q") < 18, "not_detected").when(F.col("q") < 28, "mild").when(F.col("q") < 40, "moderate").otherwise("high")
    labels = q.select("subject_id", "concern", "roi", label.alias("label"))
    return cohort.samples(labels, b).withColumn("z", F.round("z", 6))


def agreement_eval(s, d):
    rows = _samples(s, d).withColumn("predicted", vocab.to_band(F.col("z")))
    rows = rows.where(cohort.split(F.col("subject_id"), st.SALT) == "holdout")
    return cohort.evaluated(rows, ["concern"]).select("concern", "n", r6("exact"), r6("adjacent"))


def holdout_slices(s, d):
    rows = _samples(s, d).withColumn("predicted", vocab.to_band(F.col("z"))).where(cohort.split(F.col("subject_id"), st.SALT) == "holdout")
    rows = rows.join(st.subjects(s, d), "subject_id")
    long = cohort.sliced(rows, list(st.SLICES), ["concern", "predicted", "label"])
    out = cohort.evaluated(long, ["concern", "column", "value"]).withColumn("gated", F.col("n") >= vocab.MIN_SLICE)
    return out.select("concern", "column", "value", "n", r6("exact"), r6("adjacent"), "gated")


def holdout_gates(s, d):
    e = agreement_eval(s, d)
    spread = cohort.spread(holdout_slices(s, d), "exact", ["concern", "column"])
    g = vocab.GATES
    named = lambda df, name, v, bound, higher: df.select("concern", F.lit(name).alias("gate") if isinstance(name, str) else name.alias("gate"), cohort.verdict(F.col(v), bound, higher).alias("status"), F.round(v, 6).alias("value"), F.lit(bound).alias("bound"))
    return named(e, "exact_agreement", "exact", g["exact"], True).union(named(e, "adjacent_agreement", "adjacent", g["adjacent"], True)).union(named(spread, F.concat(F.lit("slice_spread["), F.col("column"), F.lit("]")), "spread", g["agreement_spread"], False))


def _region_cuts(rows):
    return cohort.fitted_cuts(rows, ["concern", "roi"]).select("concern", "roi", "n", "misclassified", *[F.round(t, 8).alias(t) for t in ("t0", "t1", "t2")], "fitted")


def threshold_fit(s, d):
    """Cuts by region of all subjects."""
    return _region_cuts(_samples(s, d))


def threshold_fit_all(s, d):
    out = cohort.fitted_cuts(_samples(s, d), ["concern"])
    return out.select("concern", "n", "misclassified", *[F.round(t, 8).alias(t) for t in ("t0", "t1", "t2")], "fitted")


def reference_coverage(s, d):
    ref = _reference(s, d, _means(s, d)).where("n_subjects >= 5 and mad > 0")
    primary = vocab.small_table(s, "concern string,roi string", [(c, f"roi_{k}") for c in st.CONCERNS for k in range(1, 9)])
    return policy.missing_regions(ref, primary).select("concern", F.array_join("missing", ",").alias("missing"))


QUERIES = {f.__name__: f for f in (subject_means, subject_split, reference_stats, zref_long, roi_band, concern_severity, public_view, majority_vote, agreement_eval, holdout_slices, holdout_gates, threshold_fit, threshold_fit_all, reference_coverage)}

_SAMPLES = f"""{st.ROI_SQL},
samples AS (
  SELECT b.subject_id, concern, roi, round(z, 6) AS z, CASE WHEN q < 18 THEN 0 WHEN q < 28 THEN 1 WHEN q < 40 THEN 2 ELSE 3 END AS lab,
    CASE WHEN round(z, 6) < 0.5 THEN 0 WHEN round(z, 6) < 1.5 THEN 1 WHEN round(z, 6) < 2.5 THEN 2 ELSE 3 END AS pred
  FROM bands b JOIN (SELECT subject_id, concern, roi, round(value, 6) AS q FROM means WHERE measurement = 'quantity') USING (subject_id, concern, roi) WHERE z IS NOT NULL)"""
_HOLD = f"{_SAMPLES}, hold AS (SELECT * FROM samples WHERE {st.SPLIT_SQL} = 'holdout')"
_EVAL = f"{_HOLD}, ev AS (SELECT concern, count(*) AS n, round(avg((lab = pred)::INT), 6) AS exact, round(avg((abs(lab - pred) <= 1)::INT), 6) AS adjacent FROM hold GROUP BY 1)"
_SLICED = f"""{_EVAL}, {st.SUBJECTS_SQL},
sl AS (SELECT concern, col AS "column", value, count(*) AS n, round(avg((lab = pred)::INT), 6) AS exact, round(avg((abs(lab - pred) <= 1)::INT), 6) AS adjacent, count(*) >= {vocab.MIN_SLICE} AS gated
  FROM (SELECT h.concern, h.lab, h.pred, c.col, trim(CASE c.col WHEN 'segment' THEN s.segment ELSE s.nation END) AS value FROM hold h JOIN subjects s USING (subject_id), (VALUES ('segment'), ('nation')) c(col))
  WHERE value <> '' GROUP BY 1, 2, 3)"""


def _fit_sql(by: str) -> str:
    """Cut-points from prefix counts and their running maxima."""
    return f"""
WITH {_SAMPLES}, rows AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY z, CASE lab WHEN 0 THEN 'not_detected' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE 'high' END) AS p FROM samples),
cum AS (
  SELECT {by}, p, z, sum((lab = 0)::INT) OVER w AS c0, sum((lab = 1)::INT) OVER w AS c1, sum((lab = 2)::INT) OVER w AS c2, sum((lab = 3)::INT) OVER w AS c3 FROM rows WINDOW w AS (PARTITION BY {by} ORDER BY p)
  UNION ALL SELECT DISTINCT {by}, 0, NULL::DOUBLE, 0, 0, 0, 0 FROM rows),
tot AS (SELECT {by}, count(*) AS n, min(z) AS lo, max(z) AS hi, sum((lab = 3)::INT) AS n3 FROM rows GROUP BY ALL),
"""


_FIT_TAIL = """
best2 AS (SELECT {by}, p AS j, max(c0 - c1) OVER (PARTITION BY {by} ORDER BY p) AS g1 FROM cum),
val2 AS (SELECT b.*, b.g1 + c.c1 - c.c2 AS g2 FROM best2 b JOIN cum c ON {on_bc} AND c.p = b.j),
best3 AS (SELECT {by}, j AS k, max(g2) OVER (PARTITION BY {by} ORDER BY j) AS g2 FROM val2),
val3 AS (SELECT b.*, b.g2 + c.c2 - c.c3 AS g3 FROM best3 b JOIN cum c ON {on_bc} AND c.p = b.k),
pick3 AS (SELECT {by}, min(k) AS k, any_value(g3) AS g3 FROM (SELECT *, max(g3) OVER (PARTITION BY {by}) AS m FROM val3) WHERE g3 = m GROUP BY ALL),
pick2 AS (SELECT {by}, k, g3, min(j) AS j FROM (SELECT p.*, v.j, v.g2, max(v.g2) OVER (PARTITION BY {by}) AS m FROM pick3 p JOIN val2 v USING ({by}) WHERE v.j <= p.k) WHERE g2 = m GROUP BY ALL),
pick1 AS (SELECT {by}, k, g3, j, min(i) AS i FROM (SELECT p.*, c.p AS i, c.c0 - c.c1 AS g1, max(c.c0 - c.c1) OVER (PARTITION BY {by}) AS m FROM pick2 p JOIN cum c USING ({by}) WHERE c.p <= p.j) WHERE g1 = m GROUP BY ALL),
mid AS (SELECT c.*, lead(z) OVER (PARTITION BY {by} ORDER BY p) AS nz FROM cum c),
cuts AS (SELECT {by}, n, n - g3 - n3 AS misclassified, i, j, k, lo, hi FROM pick1 JOIN tot USING ({by}))
SELECT {by}, n, misclassified::BIGINT AS misclassified, round(t0, 8) AS t0, round(t1, 8) AS t1, round(t2, 8) AS t2, n >= 4 AND t0 < t1 AND t1 < t2 AS fitted FROM (
  SELECT {q}, n, misclassified,
    CASE WHEN i <= 0 THEN lo - 1 WHEN i >= n THEN hi + 1 ELSE (a.z + a.nz) / 2 END AS t0,
    CASE WHEN j <= 0 THEN lo - 1 WHEN j >= n THEN hi + 1 ELSE (b.z + b.nz) / 2 END AS t1,
    CASE WHEN k <= 0 THEN lo - 1 WHEN k >= n THEN hi + 1 ELSE (c.z + c.nz) / 2 END AS t2
  FROM cuts t JOIN mid a ON {on_ta} AND a.p = t.i JOIN mid b ON {on_tb} AND b.p = t.j JOIN mid c ON {on_tc} AND c.p = t.k)
"""


def _fit(by: tuple[str, ...]) -> str:
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in by)
    names = ", ".join(by)
    return _fit_sql(names) + _FIT_TAIL.format(by=names, q=", ".join(f"t.{k}" for k in by), on_bc=on("b", "c"), on_ta=on("t", "a"), on_tb=on("t", "b"), on_tc=on("t", "c"))


_AGG = f"""{st.ROI_SQL},
agg AS (
  SELECT subject_id, concern, max(rank) AS top, count(*) FILTER (rank = mx AND mx >= 0) AS n_at_max, coalesce(bool_or(rank = mx AND strong), false) AS strong,
    coalesce(string_agg(CASE WHEN rank >= 1 THEN roi END, ',' ORDER BY roi), '') AS regions
  FROM (SELECT *, max(rank) OVER (PARTITION BY subject_id, concern) AS mx FROM bands) GROUP BY 1, 2),
final AS (
  SELECT subject_id, concern, CASE WHEN top < 0 THEN 'unmeasurable' ELSE (['not_detected', 'mild', 'moderate', 'high'])[(CASE WHEN top <= 0 OR n_at_max >= 2 OR strong THEN top ELSE top - 1 END) + 1] END AS severity,
    regions, n_at_max, NOT (top <= 0 OR n_at_max >= 2 OR strong) AS demoted FROM agg)"""

SQL = {
    "subject_means": f"WITH {st.MEANS_SQL} SELECT subject_id, concern, roi, measurement, round(value, 6) AS value, n FROM means",
    "subject_split": f"WITH {st.SUBJECTS_SQL} SELECT subject_id, {st.SPLIT_SQL} AS split FROM subjects",
    "reference_stats": f"WITH {st.REFERENCE_SQL} SELECT concern, roi, measurement, round(median, 6) AS median, round(mad, 6) AS mad, n_subjects, n_subjects >= {vocab.COHORT_FLOOR} AS calibrated FROM reference JOIN ref_n USING (concern)",
    "zref_long": f"WITH {st.Z_SQL} SELECT subject_id, concern, roi, measurement, round(z_ref, 6) AS z_ref FROM zref",
    "roi_band": f"WITH {st.ROI_SQL} SELECT subject_id, concern, roi, round(z, 6) AS z, severity, strong FROM bands",
    "concern_severity": f"WITH {_AGG} SELECT * FROM final",
    "public_view": f"WITH {_AGG} SELECT subject_id, concern, severity, regions FROM final",
    "majority_vote": """
SELECT subject_id, label, n, n_labels FROM (
  SELECT subject_id, label, n, count(*) OVER (PARTITION BY subject_id) AS n_labels, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, first) AS r
  FROM (SELECT user_id AS subject_id, event_type AS label, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)) WHERE r = 1""",
    "agreement_eval": f"WITH {_EVAL} SELECT * FROM ev",
    "holdout_slices": f"WITH {_SLICED} SELECT * FROM sl",
    "holdout_gates": f"""
WITH {_SLICED},
sp AS (SELECT concern, "column", CASE WHEN count(*) FILTER (gated) >= 2 THEN max(exact) FILTER (gated) - min(exact) FILTER (gated) END AS spread FROM sl GROUP BY 1, 2)
SELECT concern, 'exact_agreement' AS gate, CASE WHEN exact IS NULL THEN 'not_evaluated' WHEN exact >= 0.7 THEN 'pass' ELSE 'fail' END AS status, exact AS value, 0.7::DOUBLE AS bound FROM ev
UNION ALL SELECT concern, 'adjacent_agreement', CASE WHEN adjacent IS NULL THEN 'not_evaluated' WHEN adjacent >= 0.9 THEN 'pass' ELSE 'fail' END, adjacent, 0.9 FROM ev
UNION ALL SELECT concern, 'slice_spread[' || "column" || ']', CASE WHEN spread IS NULL THEN 'not_evaluated' WHEN spread <= 0.15 THEN 'pass' ELSE 'fail' END, round(spread, 6), 0.15 FROM sp""",
    "threshold_fit": _fit(("concern", "roi")),
    "threshold_fit_all": _fit(("concern",)),
    "reference_coverage": f"""
WITH {st.REFERENCE_SQL}
SELECT concern, string_agg(roi, ',' ORDER BY roi) AS missing FROM (
  SELECT c.concern, 'roi_' || k AS roi FROM (VALUES ('redness'), ('texture'), ('wrinkles')) c(concern), range(1, 9) g(k)
  EXCEPT SELECT concern, roi FROM reference JOIN ref_n USING (concern) WHERE n_subjects >= 5 AND mad > 0) GROUP BY 1""",
}
