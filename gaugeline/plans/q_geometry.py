"""Queries: scale, boxes and ring constructions from points, pixel sizes, gates, digests and data URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import robust
from gaugeline.operators import capture, cohort, forms, geometry, sweep
from gaugeline.plans import q_validation
from gaugeline.plans import standin as st
from gaugeline.sources import corpus

FRAME = (600, 400)
LIMITS = {"quantity": ("least_quantity", 20.0), "discount": ("most_discount", 0.05)}
BOUNDS = {"exact": (24.0, True), "other": (26.0, False)}


def r6(c):
    return F.round(c, 6)


def _corners(s, d):
    """Orders with three points a, b and c."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    o = st.table(s, d, "orders")
    return o.select(k.alias("id"), at(k % 700 * 0.9 - 20, c % 500 * 0.7).alias("a"), at(c % 640 * 1.1, k % 390 * 1.3 + 0.5).alias("b"), at((k + c) % 300 * 1.0, (k + 2 * c) % 450 * 0.9).alias("c"))


def face_anchors(s, d):
    """Orders with 478 points, every fifth with 470, which give no scale."""
    o = st.table(s, d, "orders")
    n = F.when(F.col("o_orderkey") % 5 == 0, 470).otherwise(478)
    points = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(((i * 7 + F.col("o_orderkey")) % 100).cast("double").alias("x"), ((i * 13 + F.col("o_custkey")) % 90).cast("double").alias("y")))
    return o.select(F.col("o_orderkey").alias("id"), r6(geometry.anchor(points)).alias("anchor"))


def face_boxes(s, d):
    box = geometry.face_box(F.array("a", "b", "c"), F.lit(FRAME[0]), F.lit(FRAME[1]))
    return _corners(s, d).select("id", box.alias("z")).select("id", *[F.col(f"z.{k}").cast("long").alias(k) for k in "xywh"])


def face_angles(s, d):
    m = geometry.face_metrics(F.col("a"), F.col("b"), F.col("c"))
    return _corners(s, d).select("id", m.alias("m")).select("id", r6("m.roll").alias("roll"), r6("m.yaw_proxy").alias("yaw_proxy"))


def ring_constructions(s, d):
    """The corners of a raised brow, of a patch beside a corner of the eye, and of a band between two lines."""
    a, b, c = (F.col(x) for x in "abc")
    rings = {"brow": geometry.extruded(F.array(a, b), F.lit(9.5)), "patch": geometry.lateral_patch(a, c["x"], F.lit(30.0), F.lit(12.0)), "band": geometry.band_between(F.array(a, b), F.array(c, c), 0.25, 0.75)}
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), r.alias("ring")) for n, r in rings.items()]))
    rows = _corners(s, d).select("id", every.alias("z")).select("id", "z.kind", F.posexplode("z.ring").alias("pos", "p"))
    return rows.select("id", "kind", "pos", r6("p.x").alias("x"), r6("p.y").alias("y"))


def pixel_sizes(s, d):
    li = st.table(s, d, "lineitem")
    q = F.col("l_quantity") * 8
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), robust.to_pixels(0.03125, q).alias("size"), robust.to_pixels(0.0625, q, odd=True, least=3).alias("odd"), robust.least_support(0.00390625, q).alias("support"))


def metric_limits(s, d):
    """Metrics' quantiles with the limits that apply."""
    return sweep.limit_index(q_validation.qc_percentiles(s, d), LIMITS).select("metric", "n", "limit_name", "limit")


def gate_verdicts(s, d):
    """Each nation's mean line quantity through two gates; of nations without lines nothing is known."""
    rows = st.table(s, d, "lineitem").join(st.captures(s, d).withColumnRenamed("image", "l_orderkey"), "l_orderkey").join(st.subjects(s, d), "subject_id")
    v = rows.groupBy("nation").agg(r6(F.avg(F.when(F.col("nation") != "CHINA", F.col("l_quantity")))).alias("value"))
    return v.select("nation", "value", *[cohort.verdict(F.col("value"), bound, higher).alias(n) for n, (bound, higher) in BOUNDS.items()])


def pinned_files(s, d):
    """Documents as files: whether their bytes have the digest of the empty file, and their digest."""
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    t = st.table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return t.select("doc_id", corpus.verified(F.col("content"), empty).alias("is_empty"), F.sha2("content", 256).alias("digest"))


def data_urls(s, d):
    """Documents as photographs in a page."""
    return st.table(s, d, "documents").select("doc_id", corpus.base64_url(F.col("text").cast("binary"), "image/png").alias("url"))


def contact_rows(s, d):
    """Customers as submissions, those with a pending order as known contacts."""
    c = st.table(s, d, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("subject_id"), F.col("c_name").alias("email"))
    known = st.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("subject_id")).distinct()
    return forms.new_contacts(c, known)


def concern_rows(s, d):
    return capture.result_rows(s, F.lit(0), {"redness", "texture"}, {"acne", "pores"})


QUERIES = {f.__name__: f for f in (face_anchors, face_boxes, face_angles, ring_constructions, pixel_sizes, metric_limits, gate_verdicts, pinned_files, data_urls, contact_rows, concern_rows)}

_CORNERS = """p AS (SELECT o_orderkey AS id, o_orderkey % 700 * 0.9::DOUBLE - 20 AS ax, o_custkey % 500 * 0.7::DOUBLE AS ay, o_custkey % 640 * 1.1::DOUBLE AS bx, o_orderkey % 390 * 1.3::DOUBLE + 0.5 AS by_,
  (o_orderkey + o_custkey) % 300 * 1.0::DOUBLE AS cx, (o_orderkey + 2 * o_custkey) % 450 * 0.9::DOUBLE AS cy FROM orders)"""
_PXS = lambda share, least: f"greatest(round_even(q * {share}::DOUBLE, 0)::INT, {least})"

SQL = {
    "face_anchors": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN round(sqrt(power((469 * 7 + o_orderkey) % 100 - (474 * 7 + o_orderkey) % 100, 2) + power((469 * 13 + o_custkey) % 90 - (474 * 13 + o_custkey) % 90, 2)), 6) END AS anchor FROM orders""",
    "face_boxes": f"""
WITH {_CORNERS}, b AS (SELECT id, greatest(floor(least(ax, bx, cx)), 0)::BIGINT AS x, greatest(floor(least(ay, by_, cy)), 0)::BIGINT AS y, least(ceil(greatest(ax, bx, cx)), {FRAME[0]})::BIGINT AS x1, least(ceil(greatest(ay, by_, cy)), {FRAME[1]})::BIGINT AS y1 FROM p)
SELECT id, x, y, greatest(x1 - x, 0) AS w, greatest(y1 - y, 0) AS h FROM b""",
    "face_angles": f"WITH {_CORNERS} SELECT id, round(degrees(atan2(by_ - ay, bx - ax)), 6) AS roll, round((cx - (ax + bx) / 2) / nullif(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)), 0), 6) AS yaw_proxy FROM p",
    "ring_constructions": f"""
WITH {_CORNERS}, s AS (SELECT *, CASE WHEN ax >= cx THEN 30.0::DOUBLE ELSE -30 END AS o FROM p), r AS (
  SELECT id, 'brow' AS kind, unnest([{{'pos': 0, 'x': ax, 'y': ay}}, {{'pos': 1, 'x': bx, 'y': by_}}, {{'pos': 2, 'x': bx, 'y': by_ - 9.5::DOUBLE}}, {{'pos': 3, 'x': ax, 'y': ay - 9.5::DOUBLE}}]) AS z FROM s
  UNION ALL SELECT id, 'patch', unnest([{{'pos': 0, 'x': ax, 'y': ay - 6}}, {{'pos': 1, 'x': ax + o, 'y': ay - 6}}, {{'pos': 2, 'x': ax + o, 'y': ay + 6}}, {{'pos': 3, 'x': ax, 'y': ay + 6}}]) FROM s
  UNION ALL SELECT id, 'band', unnest([{{'pos': 0, 'x': ax + (cx - ax) * 0.25::DOUBLE, 'y': ay + (cy - ay) * 0.25::DOUBLE}}, {{'pos': 1, 'x': bx + (cx - bx) * 0.25::DOUBLE, 'y': by_ + (cy - by_) * 0.25::DOUBLE}},
    {{'pos': 2, 'x': bx + (cx - bx) * 0.75::DOUBLE, 'y': by_ + (cy - by_) * 0.75::DOUBLE}}, {{'pos': 3, 'x': ax + (cx - ax) * 0.75::DOUBLE, 'y': ay + (cy - ay) * 0.75::DOUBLE}}]) FROM s WHERE cy > ay AND cy > by_)
SELECT id, kind, z.pos AS pos, round(z.x, 6) AS x, round(z.y, 6) AS y FROM r""",
    "pixel_sizes": f"""
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS k, (l_quantity * 8)::DOUBLE AS q FROM lineitem), m AS (SELECT id, k, {_PXS("0.03125", 1)} AS size, {_PXS("0.0625", 3)} AS odd, greatest(round_even(q * q * 0.00390625::DOUBLE, 0)::INT, 1) AS support FROM l)
SELECT id, k, size, CASE WHEN odd % 2 = 0 THEN odd + 1 ELSE odd END AS odd, support FROM m""",
    "metric_limits": f"""
WITH {st.REGIONS_SQL} SELECT metric, CASE metric WHEN 'quantity' THEN count(quantity) WHEN 'price' THEN count(price) ELSE count(discount) END AS n, CASE metric WHEN 'quantity' THEN 'least_quantity' WHEN 'discount' THEN 'most_discount' END AS limit_name,
  CASE metric WHEN 'quantity' THEN 20.0::DOUBLE WHEN 'discount' THEN 0.05::DOUBLE END AS "limit" FROM regions, (VALUES ('quantity'), ('price'), ('discount')) v(metric) GROUP BY metric""",
    "gate_verdicts": f"""
WITH {st.CAPTURES_SQL}, {st.SUBJECTS_SQL}, v AS (SELECT nation, round(avg(CASE WHEN nation <> 'CHINA' THEN l_quantity END), 6) AS value FROM lineitem JOIN captures ON image = l_orderkey JOIN subjects USING (subject_id) GROUP BY 1)
SELECT nation, value, CASE WHEN value IS NULL THEN 'not_evaluated' WHEN value >= 24 THEN 'pass' ELSE 'fail' END AS exact, CASE WHEN value IS NULL THEN 'not_evaluated' WHEN value <= 26 THEN 'pass' ELSE 'fail' END AS other FROM v""",
    "pinned_files": "SELECT doc_id, text = '' AS is_empty, sha256(text) AS digest FROM documents",
    "data_urls": "SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM documents",
    "contact_rows": "SELECT 'c-' || c_custkey AS subject_id, c_name AS email FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "concern_rows": "SELECT * FROM (VALUES ('redness', 'unmeasurable'), ('texture', 'unmeasurable'), ('acne', 'disabled'), ('pores', 'disabled')) v(concern, severity)",
}
