"""Queries: refusals and exclusions of captures, client hints, forms, label grids, licence entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import headers, vocab
from gaugeline.operators import capture, forms, geometry, policy
from gaugeline.plans import q_capture
from gaugeline.plans import standin as st
from gaugeline.sources import corpus

#: Region floors as shares of the squared anchor, and the pair that must be alike.
FLOORS, FLOOR, LEAST_VISIBILITY, ANCHOR = {"roi_1": 0.2, "roi_3": 0.05}, 0.1, 0.3, 40.0
PAIR, TOLERANCE = ("roi_1", "roi_2"), 0.5
#: Primary regions, and the grid of answers.
PRIMARY = (("redness", "roi_1"), ("redness", "roi_2"), ("texture", "roi_2"), ("wrinkles", "roi_6"))


def _areas(s, d):
    li = st.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("image"), F.concat(F.lit("roi_"), F.col("l_linenumber").cast("string")).alias("roi"), (F.col("l_quantity") * 10).alias("area"), (F.col("l_discount") * 10).alias("visibility"), F.lit(ANCHOR).alias("anchor"))


def content_mismatch(s, d):
    """Lines as uploads: the ship flags as declared content types, the supplier as the sniffed format."""
    li = st.table(s, d, "lineitem")
    fmt = F.when(F.col("l_suppkey") % 3 == 0, "jpeg").when(F.col("l_suppkey") % 3 == 1, "png")
    declared = F.when(F.col("l_returnflag") == "A", "image/png").when(F.col("l_returnflag") == "N", "").when(F.col("l_linestatus") == "F", "image/jpeg")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), headers.content_type_mismatch(fmt, declared).alias("mismatch"))


def scale_floor(s, d):
    li, row = q_capture._observed(s, d)
    return li.select("id", "k", F.array_join(capture.with_scale_floor(capture.failures(row), F.col("l_quantity") * 4), "|").alias("failures"))


def region_exclusion(s, d):
    return capture.excluded(_areas(s, d), ["image"], FLOORS, FLOOR, LEAST_VISIBILITY).select("image", "roi", F.col("area").cast("double").alias("area"), "visibility", "unusable")


def measurable_regions(s, d):
    images = st.table(s, d, "orders").select(F.col("o_orderkey").alias("image"))
    return capture.measurable(_areas(s, d), images, vocab.small_table(s, "concern string,roi string", list(PRIMARY)), 200)


def concern_refusals(s, d):
    li, row = q_capture._observed(s, d)
    concern = F.element_at(F.array(*map(F.lit, ("redness", "dark_spots", "texture", "wrinkles"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    v = capture.verdict(capture.failures(row), row["shadow"] <= 0.12)
    rows = li.select("id", "k", concern.alias("concern"), v.alias("v"))
    return rows.select("id", "k", "concern", capture.concern_refusal(F.col("concern"), F.col("v")).alias("reason"))


def client_hints(s, d):
    li = st.table(s, d, "lineitem")
    q = F.col("l_quantity")
    row = {
        "long_edge": q * 60, "luma": q * 5, "clipped_low": F.col("l_discount") * 0.25, "clipped_high": F.col("l_tax") * 0.28, "cast": F.col("l_tax") * 2.4, "detected": F.when(F.col("l_linenumber") < 6, F.col("l_suppkey") % 2 == 0),
        "face_lap": q * 9, "face_ten": q * 5, "centre_lap": q, "centre_ten": q * 0.5, "face_px": q * 30, "roll": F.col("l_tax") * 200 - 1, "yaw_proxy": F.col("l_discount") * 5,
    }
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.array_join(capture.client_reasons(row), "|").alias("reasons"))


def region_symmetry(s, d):
    areas = _areas(s, d).groupBy("image", "roi").agg(F.max("area").alias("area"))
    return geometry.symmetric(areas, [PAIR], TOLERANCE)


def undecidable_concerns(s, d):
    """Captures' concerns with a region that has no reference: here the seventh."""
    z = st.facts(s, d, subject=False).withColumn("z_ref", F.when(F.col("roi") != "roi_7", F.col("value")))
    return policy.undecidable(z, ["image"])


def form_rows(s, d):
    """Customers as submissions; every tenth has an id that the form refuses."""
    c = st.table(s, d, "customer")
    who = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("no id "), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey"))
    rows = c.select(who.alias("subject_id"), at.alias("submitted_at"), F.col("c_name").alias("name"), F.col("c_name").alias("email"), F.col("c_name").alias("phone"), F.col("c_mktsegment").alias("lighting"))
    return forms.accepted(rows).select("subject_id", "image", "lighting")


def label_grids(s, d):
    """Orders as submissions of answers, lines as answers; one line of five has no valid one."""
    li = st.table(s, d, "lineitem")
    concern = F.when(F.col("l_returnflag") == "A", "redness").when(F.col("l_returnflag") == "N", "texture").otherwise("wrinkles")
    answers = li.select(F.col("l_orderkey").alias("submission"), concern.alias("concern"), F.concat(F.lit("roi_"), F.col("l_linenumber").cast("string")).alias("roi"), F.when(F.col("l_suppkey") % 5 > 0, "mild").otherwise("perhaps").alias("severity"))
    return forms.complete_grids(vocab.small_table(s, "concern string,roi string", list(PRIMARY)), answers, ["submission"]).select("submission", F.col("missing").cast("long").alias("missing"))


def calibration_labels(s, d):
    """Events' types as answers, clicks standing for unsure ones."""
    e = st.table(s, d, "events").select(F.col("user_id").alias("subject_id"), F.when(F.col("event_type") == "click", "unsure").when(F.col("value") > 10, F.col("event_type")).alias("severity"))
    return corpus.without_unsure(e).groupBy("severity").agg(F.count("*").alias("n"))


def licence_entries(s, d):
    """Parts as components: size for the decision, brand for the version, type for the hash, the next but one as what they need."""
    p = st.table(s, d, "part")
    rows = p.select(
        F.col("p_partkey").cast("string").alias("name"),
        F.when(F.col("p_size") % 3 > 0, "eligible").otherwise("excluded").alias("decision"),
        (F.col("p_size") % 2 == 0).alias("commercial_allowed"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("version"),
        F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("hash"),
        F.array((F.col("p_partkey") + 2).cast("string")).alias("requires"),
    )
    return forms.licence_faults(rows)


QUERIES = {f.__name__: f for f in (content_mismatch, scale_floor, region_exclusion, measurable_regions, concern_refusals, client_hints, region_symmetry, undecidable_concerns, form_rows, label_grids, calibration_labels, licence_entries)}

_AREAS = f"a AS (SELECT l_orderkey AS image, 'roi_' || l_linenumber AS roi, l_quantity * 10 AS area, l_discount * 10 AS visibility, {ANCHOR}::DOUBLE AS anchor FROM lineitem)"
_GRID = "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in PRIMARY) + ") v(concern, roi))"
_CONCERN = "CASE l_returnflag WHEN 'A' THEN 'redness' WHEN 'N' THEN 'texture' ELSE 'wrinkles' END"

SQL = {
    "content_mismatch": """
SELECT id, k, coalesce(declared <> '' AND NOT contains(declared, fmt), false) AS mismatch FROM (
  SELECT l_orderkey AS id, l_linenumber AS k, CASE l_suppkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' END AS fmt, CASE WHEN l_returnflag = 'A' THEN 'image/png' WHEN l_returnflag = 'N' THEN '' WHEN l_linestatus = 'F' THEN 'image/jpeg' END AS declared FROM lineitem)""",
    "scale_floor": f"WITH {q_capture._OBS} SELECT id, k, array_to_string(CASE WHEN flap * 4 < 90 AND NOT list_contains(found, 'face_too_small') THEN list_append(found, 'face_too_small') ELSE found END, '|') AS failures FROM f",
    "region_exclusion": f"""
WITH {_AREAS}, b AS (SELECT *, area < CASE roi {" ".join(f"WHEN '{r}' THEN {v}::DOUBLE" for r, v in FLOORS.items())} ELSE {FLOOR}::DOUBLE END * anchor * anchor OR visibility < {LEAST_VISIBILITY}::DOUBLE AS unusable FROM a)
SELECT image, roi, CASE WHEN unusable THEN 0 ELSE area END AS area, CASE WHEN unusable THEN 0 ELSE visibility END AS visibility, unusable FROM b""",
    "measurable_regions": f"""
WITH {_AREAS}, {_GRID} SELECT o_orderkey AS image, g.concern, g.roi, CASE WHEN area IS NULL OR area = 0 THEN 'absent' WHEN area < 200 THEN 'below_floor' END AS reason
FROM orders CROSS JOIN g LEFT JOIN a ON a.image = o_orderkey AND a.roi = g.roi""",
    "concern_refusals": f"""
WITH {q_capture._OBS}, r AS (SELECT *, ['redness', 'dark_spots', 'texture', 'wrinkles'][l_partkey % 4 + 1] AS concern FROM f)
SELECT id, k, concern, CASE WHEN concern = 'redness' AND list_contains(found, 'color_cast') THEN 'color_cast' WHEN concern = 'dark_spots' AND NOT shadow <= 0.12 THEN 'shadow_asymmetry'
  WHEN concern <> 'redness' AND list_has_any(found, ['underexposed', 'overexposed']) THEN 'exposure' END AS reason FROM r""",
    "client_hints": """
WITH r AS (SELECT l_orderkey AS id, l_linenumber AS k, l_quantity AS q, l_discount * 0.25::DOUBLE AS lo, l_tax * 0.28::DOUBLE AS hi, l_tax * 2.4::DOUBLE AS cst, l_linenumber < 6 AND l_suppkey % 2 = 0 AS face, l_tax * 200 - 1 AS roll, l_discount * 5 AS yaw FROM lineitem)
SELECT id, k, array_to_string(list_sort(list_filter([CASE WHEN q * 60 < 900 THEN 'too_small' END, CASE WHEN q * 5 < 60 THEN 'too_dark' END, CASE WHEN q * 5 > 200 THEN 'too_bright' END, CASE WHEN greatest(lo, hi) > 0.02 THEN 'clipped' END,
  CASE WHEN cst > 0.18 THEN 'color_cast' END, CASE WHEN face AND q * 30 < 768 THEN 'face_too_small' END, CASE WHEN face AND abs(roll) > 10 THEN 'tilted' END, CASE WHEN face AND abs(yaw) > 0.35 THEN 'turned' END,
  CASE WHEN (face AND (q * 9 < 120 OR q * 5 < 60)) OR (NOT face AND (q < 15 OR q * 0.5 < 8)) THEN 'blur' END], lambda x: x IS NOT NULL)), '|') AS reasons FROM r""",
    "region_symmetry": f"""
WITH {_AREAS} SELECT image, coalesce(abs(x - y) <= {TOLERANCE}::DOUBLE * greatest(x, y), false) AS symmetry_ok
FROM (SELECT image, max(area) FILTER (roi = '{PAIR[0]}') AS x, max(area) FILTER (roi = '{PAIR[1]}') AS y FROM a GROUP BY 1)""",
    "undecidable_concerns": f"SELECT DISTINCT l_orderkey AS image, {_CONCERN} AS concern FROM lineitem WHERE l_linenumber = 7",
    "form_rows": """
SELECT 'c-' || c_custkey AS subject_id, 'c-' || c_custkey || '_' || strftime(make_timestamp((1700000000 + c_custkey) * 1000000), '%Y%m%dT%H%M%SZ') || '.jpg' AS image, c_mktsegment AS lighting FROM customer WHERE c_custkey % 10 > 1""",
    "label_grids": f"""
WITH {_GRID}, l AS (SELECT l_orderkey AS submission, {_CONCERN} AS concern, 'roi_' || l_linenumber AS roi, l_suppkey % 5 > 0 AS ok FROM lineitem)
SELECT submission, 4 - count(DISTINCT CASE WHEN ok THEN g.concern || g.roi END) AS missing FROM l LEFT JOIN g USING (concern, roi) GROUP BY 1""",
    "calibration_labels": "SELECT severity, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'unsure' WHEN value > 10 THEN event_type END AS severity FROM events) WHERE severity IS DISTINCT FROM 'unsure' GROUP BY 1",
    "licence_entries": """
WITH e AS (SELECT p_partkey, p_partkey::VARCHAR AS name, p_size % 3 > 0 AS eligible, p_size % 2 = 0 AS commercial, p_size % 5 > 0 AND trim(p_brand) <> '' AS versioned, p_size % 7 > 0 AND trim(p_type) <> '' AS hashed FROM part)
SELECT name, 'decision' AS fault FROM e WHERE eligible <> commercial UNION ALL SELECT name, 'version' FROM e WHERE eligible AND NOT versioned UNION ALL SELECT name, 'hash' FROM e WHERE eligible AND NOT hashed
UNION ALL SELECT name, 'requires ' || (p_partkey + 2) FROM e WHERE p_partkey + 2 NOT IN (SELECT p_partkey FROM part)""",
}
