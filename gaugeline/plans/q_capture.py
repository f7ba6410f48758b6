"""Queries: headers, limits, routing, capture quality, forms, configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions import headers, vocab
from gaugeline.operators import capture, forms
from gaugeline.plans import standin as st
from gaugeline.sources import corpus

# A few headers' first bytes.
HEADERS = {
    "png": "89504E470D0A1A0A0000000D49484452000003200000028008020000",
    "png_short": "89504E470D0A1A0A0000000D49484452",
    "webp_x": "524946460000000057454250565038580A00000000000000F3010000270100",
    "webp_l": "5249464600000000574542505650384C000000002FF3C1490011",
    "webp_lossy": "5249464600000000574542505650382000000000" "0000009D012AF40128010000",
    "gif": "474946383961010001000000000000000000000000000000",
    "jpeg": "FFD8FFE000104A46494600010100000100010000FFC0001108028003200301220002110103110100",
    "jpeg_progressive": "FFD8FFE10006AABBCCDDFFDB0004FFC0FFC2001108012C01900301220002110103110100",
    "jpeg_frameless": "FFD8FFE10006AABBCCDDFFD9",
}


def _headers(s):
    return vocab.small_table(s, "name string,hexed string", sorted(HEADERS.items())).select("name", F.unhex("hexed").alias("content"))


def sniff_headers(s, d):
    return _headers(s).select("name", headers.sniffed(F.col("content")).alias("fmt"))


def png_header(s, d):
    rows = _headers(s).select("name", headers.png_size(F.col("content")).alias("z")).where("name like 'png%'")
    return rows.select("name", "z.width", "z.height")


def webp_header(s, d):
    rows = _headers(s).select("name", headers.webp_size(F.col("content")).alias("z")).where("name like 'webp%'")
    return rows.select("name", "z.width", "z.height")


def jpeg_header(s, d):
    rows = _headers(s).where("name like 'jpeg%'").select("name", headers.jpeg_size("content").alias("z"))
    return rows.select("name", "z.width", "z.height")


def _requests(s, d):
    """Lines as requests: price as bytes, quantity and tax as sides, the ship mode's flags as the rest."""
    li = st.table(s, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("k"),
        (F.col("l_extendedprice") * 200).cast("long").alias("n_bytes"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_suppkey") % 3 == 0, "jpeg").when(F.col("l_suppkey") % 3 == 1, "png").otherwise("gif").alias("fmt"),
        (F.col("l_quantity") * 200).cast("int").alias("width"),
        (F.col("l_partkey") * 7 % 9000 + 100).cast("int").alias("height"),
        (F.col("l_returnflag") == "R").alias("unverified"),
        (F.col("l_linestatus") == "O").alias("qc_passed"),
        (F.col("l_discount") > 0.05).alias("publishable"),
    )


def limits(s, d):
    return _requests(s, d).select("id", "k", "n_bytes", headers.limit_refusal(F.col("fmt"), F.col("width"), F.col("height")).alias("refusal"))


def outcome_routing(s, d):
    r = _requests(s, d)
    o = headers.outcome(F.col("n_bytes"), headers.limit_refusal(F.col("fmt"), F.col("width"), F.col("height")), F.col("unverified"), F.col("qc_passed"), F.col("publishable"))
    return r.select("id", "k", "n_bytes", o.alias("o")).select("id", "k", "n_bytes", "o.status_code", "o.outcome", "o.reason")


def latency_budget(s, d):
    e = st.table(s, d, "events").select("event_type", (F.col("value") * 40).alias("ms")).where("ms is not null")
    f = e.select("event_type", headers.latency_flags(F.col("ms")).alias("f"))
    return f.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("f.within_p50").alias("within_p50"), F.count_if("f.within_p95").alias("within_p95"))


def _observed(s, d):
    """Lines as observations of a face."""
    q = lambda c, m, b=0.0: (F.col(c) * m + b).cast("double")
    li = st.table(s, d, "lineitem").withColumns({"id": F.col("l_orderkey"), "k": F.col("l_linenumber")})
    row = {
        "n_faces": (F.col("l_suppkey") % 4).cast("int"), "face_h": q("l_quantity", 20), "frame_h": F.lit(1500.0), "face_w": q("l_quantity", 30), "yaw": q("l_discount", 200, -4), "pitch": q("l_tax", 220, -2), "roll": q("l_tax", 120, -1),
        "lap": q("l_quantity", 9), "ten": q("l_quantity", 5), "luma": q("l_quantity", 5), "clipped_low": q("l_discount", 0.25), "clipped_high": q("l_tax", 0.28), "specular": q("l_tax", 1.1), "shadow": q("l_discount", 1.7), "cast": q("l_tax", 2.4),
        "visibility": F.create_map(F.lit("a"), q("l_discount", 7), F.lit("b"), q("l_tax", 7)), "beard": q("l_discount", 3.2), "glasses": q("l_tax", 2.7), "frame_lap": q("l_quantity", 1), "frame_ten": q("l_quantity", 0.5),
    }
    return li, row


def capture_failures(s, d):
    li, row = _observed(s, d)
    found = capture.failures(row)
    out = li.select("id", "k", "l_suppkey", "l_partkey", F.array_join(found, "|").alias("failures"), F.array_join(capture.precheck(row), "|").alias("precheck"), F.round(capture.glasses_metric(row["beard"], row["glasses"]), 6).alias("glasses"))
    return out


def capture_verdicts(s, d):
    li, row = _observed(s, d)
    v = capture.verdict(capture.failures(row), row["shadow"] <= 0.12)
    return li.select(v.alias("v")).groupBy("v.passed", "v.blur_pass", "v.exposure_pass", "v.color_pass", "v.pose_pass", "v.shadow_pass").agg(F.count("*").alias("n"))


#: Customers' keys that are numbered together.
_KEYS = 1 << 16


def _positions(s, d):
    """(subject_id, position) of all customers in order of their key, numbered in ranges of keys."""
    c = st.table(s, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.floor(F.col("c_custkey") / _KEYS).alias("range"))
    sizes = c.groupBy("range").agg(F.count("*").alias("n"))
    # one row for each range of keys
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("subject_id"))
    return c.withColumn("own", own).join(before, "range").select("subject_id", (F.col("before") + F.col("own")).cast("long").alias("position"))


def _labels(s, approved, d):
    """(rater_id, subject_id): events in turn over all customers."""
    n = approved.count()
    e = st.table(s, d, "events").select(F.col("user_id").alias("rater_id"), (F.pmod("event_id", F.lit(max(n, 1))) + 1).cast("long").alias("position"))
    return e.join(approved, "position").select("rater_id", "subject_id")


def label_queue(s, d):
    """Each user's first customer without an event of theirs, all customers as subjects in order of their key."""
    approved = _positions(s, d)
    raters = st.table(s, d, "events").select(F.col("user_id").alias("rater_id")).distinct()
    return forms.next_subjects(approved, _labels(s, approved, d), raters)


def rater_progress(s, d):
    """Customers that each user has an event for."""
    return forms.progress(_labels(s, _positions(s, d), d))


def config_merge(s, d):
    """Parts' prices by name over suppliers' balances by name, as flat configuration paths."""
    base = st.table(s, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("path"), F.round("p_retailprice", 2).alias("value"))
    over = st.table(s, d, "supplier").select(F.concat(F.lit("k"), (F.col("s_suppkey") * 3).cast("string")).alias("path"), F.round("s_acctbal", 2).alias("value"))
    return corpus.merged_paths(base, over)


def concern_vocabulary(s, d):
    keys = vocab.small_table(s, "key string", [(k,) for k in [*vocab.CONCERN_VALUES, "unknown"]])
    return keys.select("key", vocab.value_of_key(F.col("key")).alias("value"), vocab.key_of_value(vocab.value_of_key(F.col("key"))).alias("back"))


QUERIES = {f.__name__: f for f in (sniff_headers, png_header, webp_header, jpeg_header, limits, outcome_routing, latency_budget, capture_failures, capture_verdicts, label_queue, rater_progress, config_merge, concern_vocabulary)}

_HEX = ", ".join(f"('{k}', '{v}')" for k, v in sorted(HEADERS.items()))
_H = f"h AS (SELECT name, hexed AS x FROM (VALUES {_HEX}) v(name, hexed))"
_BE = lambda at, n: f"('0x' || substr(x, {2 * at + 1}, {2 * n}))::BIGINT"
_LE = lambda at, n: "(" + " + ".join(f"{_BE(at + k, 1)} * {256**k}" for k in range(n)) + ")"
_REQ = """req AS (
  SELECT l_orderkey AS id, l_linenumber AS k, floor(l_extendedprice * 200)::BIGINT AS n_bytes, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'jpeg' WHEN l_suppkey % 3 = 1 THEN 'png' ELSE 'gif' END AS fmt,
    (l_quantity * 200)::INT AS w, (l_partkey * 7 % 9000 + 100)::INT AS h, l_returnflag = 'R' AS unverified, l_linestatus = 'O' AS ok, l_discount > 0.05 AS pub FROM lineitem),
lim AS (SELECT *, CASE WHEN fmt IS NULL OR fmt NOT IN ('jpeg', 'png', 'webp') THEN 'unsupported_image' WHEN w::BIGINT * h > 50000000 THEN 'image_too_large' WHEN least(w, h) < 240 THEN 'image_too_small' END AS refusal FROM req)"""
_OBS = """o AS (
  SELECT l_orderkey AS id, l_linenumber AS k, l_suppkey, l_partkey, l_suppkey % 4 AS n_faces, l_quantity * 20 AS face_h, l_quantity * 30 AS face_w, l_discount * 200 - 4 AS yaw, l_tax * 220 - 2 AS pitch, l_tax * 120 - 1 AS roll,
    l_quantity * 9 AS lap, l_quantity * 5 AS ten, l_quantity * 5 AS luma, l_discount * 0.25::DOUBLE AS lo, l_tax * 0.28::DOUBLE AS hi, l_tax * 1.1::DOUBLE AS spec, l_discount * 1.7::DOUBLE AS shadow, l_tax * 2.4::DOUBLE AS cst,
    greatest(l_discount * 7, l_tax * 7) AS vis, l_discount * 3.2::DOUBLE AS beard, l_tax * 2.7::DOUBLE AS glasses, l_quantity AS flap, l_quantity * 0.5::DOUBLE AS ften FROM lineitem),
f AS (
  SELECT *, CASE WHEN n_faces < 1 THEN ['no_face'] ELSE list_sort(list_distinct(list_filter([
      CASE WHEN n_faces > 1 THEN 'multiple_faces' END, CASE WHEN face_h / 1500.0 < 0.35 OR face_w < 768 THEN 'face_too_small' END, CASE WHEN abs(yaw) > 15 OR abs(pitch) > 15 OR abs(roll) > 10 THEN 'extreme_pose' END,
      CASE WHEN lap < 120 OR ten < 60 THEN 'blur' END, CASE WHEN luma < 60 OR lo > 0.02 THEN 'underexposed' END, CASE WHEN luma > 200 OR hi > 0.02 THEN 'overexposed' END, CASE WHEN spec > 0.08 THEN 'overexposed' END,
      CASE WHEN shadow > 0.15 THEN 'shadow_asymmetry' END, CASE WHEN cst > 0.18 THEN 'color_cast' END, CASE WHEN vis < 0.6 THEN 'insufficient_roi_visibility' END, CASE WHEN beard > 0.3 OR (beard <= 0.3 AND glasses > 0.2) THEN 'occlusion' END],
      lambda x: x IS NOT NULL))) END AS found FROM o)"""

_TURNS = """a AS (SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY c_custkey) AS position FROM customer),
l AS (SELECT DISTINCT user_id AS rater_id, event_id % (SELECT count(*) FROM customer) + 1 AS position FROM events)"""

SQL = {
    "sniff_headers": f"WITH {_H} SELECT name, CASE WHEN substr(x, 1, 6) = 'FFD8FF' THEN 'jpeg' WHEN substr(x, 1, 16) = '89504E470D0A1A0A' THEN 'png' WHEN substr(x, 1, 8) = '52494646' AND substr(x, 17, 8) = '57454250' THEN 'webp' END AS fmt FROM h",
    "png_header": f"WITH {_H} SELECT name, CASE WHEN length(x) >= 48 AND substr(x, 25, 8) = '49484452' THEN {_BE(16, 4)} END AS width, CASE WHEN length(x) >= 48 AND substr(x, 25, 8) = '49484452' THEN {_BE(20, 4)} END AS height FROM h WHERE name LIKE 'png%'",
    "webp_header": f"""
WITH {_H} SELECT name,
  CASE substr(x, 25, 8) WHEN '56503858' THEN {_LE(24, 3)} + 1 WHEN '56503820' THEN {_LE(26, 2)} & 16383 WHEN '5650384C' THEN ({_LE(21, 4)} & 16383) + 1 END AS width,
  CASE substr(x, 25, 8) WHEN '56503858' THEN {_LE(27, 3)} + 1 WHEN '56503820' THEN {_LE(28, 2)} & 16383 WHEN '5650384C' THEN (({_LE(21, 4)} >> 14) & 16383) + 1 END AS height FROM h WHERE name LIKE 'webp%'""",
    "jpeg_header": f"""
WITH RECURSIVE {_H}, w AS (SELECT name, x, 4 AS spot FROM h WHERE name LIKE 'jpeg%' UNION ALL SELECT name, x, spot + 4 + 2 * ('0x' || substr(x, spot + 5, 4))::INT FROM w WHERE substr(x, spot + 1, 4) NOT IN ('FFC0', 'FFC1', 'FFC2', 'FFD9') AND spot + 8 <= length(x)),
f AS (SELECT name, ('0x' || substr(x, spot + 15, 4))::INT AS width, ('0x' || substr(x, spot + 11, 4))::INT AS height FROM w WHERE substr(x, spot + 1, 4) IN ('FFC0', 'FFC1', 'FFC2'))
SELECT name, width, height FROM h LEFT JOIN f USING (name) WHERE name LIKE 'jpeg%'""",
    "limits": f"WITH {_REQ} SELECT id, k, n_bytes, refusal FROM lim",
    "outcome_routing": f"""
WITH {_REQ} SELECT id, k, n_bytes,
  CASE WHEN n_bytes > 12000000 OR refusal = 'image_too_large' THEN 413 WHEN refusal = 'image_too_small' THEN 400 WHEN refusal = 'unsupported_image' THEN 415 WHEN unverified THEN 500 WHEN NOT ok THEN 200 WHEN NOT pub THEN 503 ELSE 200 END AS status_code,
  CASE WHEN n_bytes > 12000000 OR refusal IS NOT NULL OR unverified THEN 'rejected' WHEN NOT ok THEN 'retake_required' WHEN NOT pub THEN 'not_available' ELSE 'analysis' END AS outcome,
  CASE WHEN n_bytes > 12000000 THEN 'image_too_large' WHEN refusal IS NOT NULL THEN refusal WHEN unverified THEN 'service_misconfigured' END AS reason FROM lim""",
    "latency_budget": "SELECT event_type, count(*) AS n, count(*) FILTER (value * 40 <= 1500) AS within_p50, count(*) FILTER (value * 40 <= 3000) AS within_p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "capture_failures": f"""
WITH {_OBS} SELECT id, k, l_suppkey, l_partkey, array_to_string(found, '|') AS failures,
  array_to_string(list_filter([CASE WHEN flap < 15 OR ften < 8 THEN 'blur' END, CASE WHEN cst > 0.18 THEN 'color_cast' END], lambda x: x IS NOT NULL), '|') AS precheck, round(CASE WHEN beard <= 0.3 THEN glasses END, 6) AS glasses FROM f""",
    "capture_verdicts": f"""
WITH {_OBS} SELECT len(found) = 0 AS passed, NOT list_contains(found, 'blur') AS blur_pass, NOT list_has_any(found, ['underexposed', 'overexposed']) AS exposure_pass, NOT list_contains(found, 'color_cast') AS color_pass,
  NOT list_contains(found, 'extreme_pose') AS pose_pass, shadow <= 0.12 AS shadow_pass, count(*) AS n FROM f GROUP BY ALL""",
    "label_queue": f"""
WITH {_TURNS}, w AS (SELECT rater_id, position, row_number() OVER (PARTITION BY rater_id ORDER BY position) AS k FROM l),
g AS (SELECT rater_id, coalesce(min(k) FILTER (position <> k), count(*) + 1) AS position FROM w GROUP BY 1)
SELECT rater_id, subject_id FROM g JOIN a USING (position)""",
    "rater_progress": f"WITH {_TURNS} SELECT rater_id, count(*) AS done FROM l GROUP BY 1",
    "config_merge": """
SELECT coalesce(a.path, b.path) AS path, coalesce(b.value, a.value) AS value FROM (SELECT 'k' || p_partkey AS path, round(p_retailprice, 2) AS value FROM part) a
FULL JOIN (SELECT 'k' || (s_suppkey * 3) AS path, round(s_acctbal, 2) AS value FROM supplier) b ON a.path = b.path""",
    "concern_vocabulary": "SELECT key, value, CASE WHEN value IS NOT NULL THEN key END AS back FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in vocab.CONCERN_VALUES.items()) + ", ('unknown', NULL)) v(key, value)",
}
