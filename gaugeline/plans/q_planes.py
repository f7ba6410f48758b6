"""Queries: small planes (embeddings as 8 x 8), stencils, co-occurrence, local scores, sweeps, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import robust
from gaugeline.operators import geometry, planes, sweep
from gaugeline.plans import standin as st
from gaugeline.plans.q_cohort import r6

SIDE, ANCHOR = 8, 100.0


def up6(c: str) -> F.Column:
    """Rounded where exact ties are likely: they go up in any engine."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


def _planes(s, d):
    e = st.table(s, d, "embeddings")
    v = F.transform("embedding", lambda x: F.round(F.least(F.greatest((x.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0)), 3))
    return e.select(F.col("vec_id").alias("image"), F.col("label"), F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"), v.alias("plane"))


def _pixels(s, d):
    return planes.pixels(_planes(s, d), ["image", "label"])


def plane_blur_metrics(s, d):
    return planes.with_focus(_planes(s, d)).select("image", up6("laplacian_var"), up6("tenengrad"))


def plane_focus_interior(s, d):
    return planes.with_focus(_planes(s, d), interior=True).select("image", up6("laplacian_var"), up6("tenengrad"))


def plane_gradient(s, d):
    return planes.with_gradient_energy(_planes(s, d), ANCHOR).select("image", F.round("gradient_energy", 4).alias("gradient_energy"))


def plane_glcm(s, d):
    steps = planes.offsets([max(1, round(f * ANCHOR)) for f in (0.004, 0.008, 0.016)])
    return planes.glcm(_planes(s, d), ["image"], steps).select("image", *[up6(c) for c in ("contrast", "homogeneity", "energy", "entropy")])


def plane_variance(s, d):
    return _pixels(s, d).groupBy("image").agg(F.var_pop("v").alias("local_variance"), F.avg("v").alias("mean")).select("image", up6("local_variance"), up6("mean"))


def mad_by_group(s, d):
    return robust.medians_and_mads(_pixels(s, d), ["label"], "v").select("label", r6("median"), F.round(robust.scaled_mad(F.col("mad")), 6).alias("mad"))


def trimmed_mean(s, d):
    return robust.robust_mean(_pixels(s, d), ["label"], "v").select("label", "n", r6("robust_mean"))


def local_z(s, d):
    return planes.local_z(_pixels(s, d), ["image"]).select("image", "y", "x", r6("delta"), r6("z"))


def redness_measures(s, d):
    """Affected area, median positive and 90th percentile of the local difference, by plane."""
    z = planes.local_z(_pixels(s, d), ["image"])
    pos = F.when(F.col("delta") > 0, F.col("delta"))
    return z.groupBy("image").agg(F.round(F.avg((F.col("z") >= 1.5).cast("double")), 6).alias("affected_area_ratio"), F.round(F.coalesce(F.median(pos), F.lit(0.0)), 6).alias("median_positive_delta"), F.round(robust.percentile("delta", 0.9), 6).alias("p90_delta"))


def unit_scale(s, d):
    return robust.unit_scale(_pixels(s, d), ["image"], "v").select("image", "y", "x", r6("unit"))


def gray_world(s, d):
    """Rows 0-1, 2-4 and 5-7 of a plane as its three channels."""
    ch = lambda lo, hi: F.when(F.col("y").between(lo, hi), F.col("v"))
    g = _pixels(s, d).groupBy("image").agg(planes.gray_world(ch(0, 1), ch(2, 4), ch(5, 7)).alias("g"))
    return g.select("image", *[F.round(f"g.{c}", 6).alias(c) for c in ("deviation", "b", "g", "r")])


def lr_asymmetry(s, d):
    masked = _pixels(s, d).where("v > 60 and (image % 7 <> 0 or x < 4)")
    out = planes.sides(masked, ["image"])
    return out.select("image", r6("asymmetry"), r6("dark_share"), "ok", "failed")


def deterministic_subsample(s, d):
    return robust.even_subsample(_pixels(s, d).where("v > 100"), ["image"], ["y", "x"], 9).select("image", "y", "x", "v")


def _swept(s, d):
    p = _planes(s, d)
    blurred = planes.settled(p, "plane").withColumn("plane", planes.stencil(F.col("plane"), F.col("w"), F.col("h"), planes.BOX))
    a = planes.with_focus(p).select("image", "label", F.round("laplacian_var", 4).alias("laplacian_var"), F.round("tenengrad", 4).alias("tenengrad"))
    b = planes.with_focus(blurred).select("image", F.round("tenengrad", 4).alias("blurred"))
    return a.join(b, "image").withColumn("relative_drift", robust.relative_drift(F.col("tenengrad"), F.col("blurred")))


def blur_drift(s, d):
    return _swept(s, d).select("image", "label", "laplacian_var", "tenengrad", "blurred", r6("relative_drift"))


def threshold_sweep(s, d):
    rows = _swept(s, d).withColumn("laplacian_var", F.col("laplacian_var") / 10000)
    return sweep.sweep_thresholds(rows, ["label"]).select("label", "threshold", "n", "min_tenengrad", r6("p50_drift"), r6("p95_drift"))


def recommend_floor(s, d):
    return sweep.recommended_floor(threshold_sweep(s, d), ["label"], 0.88)


def strictest_floor(s, d):
    return sweep.strictest(recommend_floor(s, d))


def hull_membership(s, d):
    """Points of all lines in the hull of the same supplier's lines with a low tax."""
    pts = st.table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), "l_tax").distinct()
    edges = geometry.hull(pts.where("l_tax <= 0.04"), ["g"])
    return geometry.inside_hull(pts.select("g", "x", "y").distinct(), edges, ["g"]).select("g", "x", "y")


def pair_asymmetry(s, d):
    """Regions 2 and 3, 4 and 5, 6 and 7 as left and right."""
    r = st.regions(s, d).withColumn("k", F.substring("roi", 5, 1).cast("int")).where("k >= 2")
    side = F.when(F.col("k") % 2 == 0, F.lit("left_")).otherwise(F.lit("right_"))
    r = r.withColumn("roi", F.concat(side, F.floor(F.col("k") / 2).cast("string")))
    return geometry.paired(r, ["image", "concern"], "quantity").select("image", "concern", "roi", r6("left"), r6("right"), r6("asymmetry"))


def run_lengths(s, d):
    return geometry.runs(_pixels(s, d).where("v > 110"), ["image", "y"], "x").select("image", "y", "start", "length")


def skin_consensus(s, d):
    patches = _pixels(s, d).groupBy("image", F.floor(F.col("y") / 2).alias("patch")).agg(F.median("v").alias("median"))
    return planes.consensus(patches, ["image"], outlier=1.0).select("image", r6("reference"), "n_patches")


def color_lab(s, d):
    """Lab of the colours that the parts' sizes and prices name."""
    p = st.table(s, d, "part")
    c = lambda k: F.pmod(F.col("p_partkey") * k, F.lit(256)).cast("double")
    rows = p.select("p_partkey", planes.lab(c(37), c(91), c(151)).alias("lab"))
    return rows.select("p_partkey", F.round("lab.l", 4).alias("l"), F.col("lab.a").alias("a"), F.col("lab.b").alias("b"), F.round(planes.chroma(F.col("lab.a"), F.col("lab.b")), 6).alias("chroma"), F.round(planes.luminance(F.col("lab.l")), 4).alias("luma"))


QUERIES = {
    f.__name__: f
    for f in (plane_blur_metrics, plane_focus_interior, plane_gradient, plane_glcm, plane_variance, mad_by_group, trimmed_mean, local_z, redness_measures, unit_scale, gray_world, lr_asymmetry, deterministic_subsample, blur_drift, threshold_sweep, recommend_floor, strictest_floor, hull_membership, pair_asymmetry, run_lengths, skin_consensus, color_lab)
}

_PX = "px AS (SELECT vec_id AS image, label, (i - 1) // 8 AS y, ((i - 1) % 8)::INT AS x, round(least(greatest((embedding[i]::DOUBLE + 0.5) * 255, 0), 255), 3) AS v FROM embeddings, range(1, 65) g(i))"
# px2: the plane with one mirrored pixel on each side
_PAD = f"""{_PX},
pad AS (SELECT p.image, p.label, a.yy, b.xx, p.v FROM px p
  JOIN (SELECT k AS yy, CASE WHEN k < 0 THEN -k WHEN k > 7 THEN 14 - k ELSE k END AS y FROM range(-1, 9) g(k)) a ON a.y = p.y
  JOIN (SELECT k AS xx, CASE WHEN k < 0 THEN -k WHEN k > 7 THEN 14 - k ELSE k END AS x FROM range(-1, 9) g(k)) b ON b.x = p.x)"""


def _st(name: str, src: str) -> str:
    """Laplacian, Sobel and box sums by pixel of a padded plane."""
    w = lambda m: " + ".join(f"{k} * v" if False else f"{k}::DOUBLE * max(CASE WHEN q.yy = p.y + ({dy}) AND q.xx = p.x + ({dx}) THEN q.v END)" for (dy, dx), k in m.items())
    box = "avg(q.v)"
    return f"""{name} AS (SELECT p.image, p.label, p.y, p.x, {w(planes.LAPLACIAN)} AS lap, {w(planes.SOBEL_X)} AS gx, {w(planes.SOBEL_Y)} AS gy, {box} AS box
  FROM {src[0]} p JOIN {src[1]} q ON q.image = p.image AND q.yy BETWEEN p.y - 1 AND p.y + 1 AND q.xx BETWEEN p.x - 1 AND p.x + 1 GROUP BY 1, 2, 3, 4)"""


_ST = f"{_PAD}, {_st('st', ('px', 'pad'))}"
_MED = "stat AS (SELECT {by}, median(v) AS med, mad(v) AS mad FROM px GROUP BY {by})"
_LZ = f"{_PX}, {_MED.format(by='image')}, lz AS (SELECT px.*, v - med AS delta, (v - med) / (1.4826::DOUBLE * mad + 1e-6::DOUBLE) AS z FROM px JOIN stat USING (image))"
_DRIFT = f"""{_ST},
px2 AS (SELECT image, label, y, x, box AS v FROM st),
pad2 AS (SELECT p.image, p.label, a.yy, b.xx, p.v FROM px2 p
  JOIN (SELECT k AS yy, CASE WHEN k < 0 THEN -k WHEN k > 7 THEN 14 - k ELSE k END AS y FROM range(-1, 9) g(k)) a ON a.y = p.y
  JOIN (SELECT k AS xx, CASE WHEN k < 0 THEN -k WHEN k > 7 THEN 14 - k ELSE k END AS x FROM range(-1, 9) g(k)) b ON b.x = p.x),
{_st("st2", ("px2", "pad2"))},
drift AS (
  SELECT a.image, a.label, a.laplacian_var, a.tenengrad, b.blurred, abs(b.blurred - a.tenengrad) / greatest(abs(a.tenengrad), 1e-9) AS relative_drift
  FROM (SELECT image, label, round(var_pop(lap), 4) AS laplacian_var, round(avg(gx * gx + gy * gy), 4) AS tenengrad FROM st GROUP BY 1, 2) a
  JOIN (SELECT image, round(avg(gx * gx + gy * gy), 4) AS blurred FROM st2 GROUP BY 1) b USING (image))"""
_SWEEP = f"""{_DRIFT},
d2 AS (SELECT *, laplacian_var / 10000 AS lv FROM drift),
cuts AS (SELECT DISTINCT label, round(lv, 1) AS threshold FROM d2),
swept AS (SELECT c.label, threshold, count(*) AS n, min(tenengrad) AS min_tenengrad, round(quantile_cont(relative_drift, 0.5), 6) AS p50_drift, round(quantile_cont(relative_drift, 0.95), 6) AS p95_drift
  FROM cuts c JOIN d2 ON d2.label = c.label AND lv >= threshold GROUP BY 1, 2 HAVING count(*) >= 5)"""
_OFFS = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(planes.offsets([max(1, round(f * ANCHOR)) for f in (0.004, 0.008, 0.016)])))
_LIN = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_F = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0::DOUBLE / 116 END"

SQL = {
    "plane_blur_metrics": f"WITH {_ST} SELECT image, round(var_pop(lap) + 1e-9, 6) AS laplacian_var, round(avg(gx * gx + gy * gy) + 1e-9, 6) AS tenengrad FROM st GROUP BY 1",
    "plane_focus_interior": f"WITH {_ST} SELECT image, round(var_pop(lap) + 1e-9, 6) AS laplacian_var, round(avg(gx * gx + gy * gy) + 1e-9, 6) AS tenengrad FROM st WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1",
    "plane_gradient": f"WITH {_ST} SELECT image, round(avg(sqrt(gx * gx + gy * gy)) * {ANCHOR}, 4) AS gradient_energy FROM st GROUP BY 1",
    "plane_glcm": f"""
WITH {_PX}, q AS (SELECT image, y, x, least(greatest(v * (64 / 255.0::DOUBLE), 0), 63)::DOUBLE AS f FROM px), qq AS (SELECT image, y, x, floor(f)::INT AS q FROM q),
o AS (SELECT * FROM (VALUES {_OFFS}) v(o, dy, dx)),
one AS (SELECT a.image, o.o, a.q AS i, b.q AS j FROM qq a, o JOIN qq b ON b.image = a.image AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
both_ AS (SELECT * FROM one UNION ALL SELECT image, o, j, i FROM one),
cells AS (SELECT image, o, i, j, count(*) / sum(count(*)) OVER (PARTITION BY image, o) AS p FROM both_ GROUP BY 1, 2, 3, 4),
per AS (SELECT image, o, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(-p * log2(p)) AS entropy FROM cells GROUP BY 1, 2)
SELECT image, round(avg(contrast) + 1e-9, 6) AS contrast, round(avg(homogeneity) + 1e-9, 6) AS homogeneity, round(avg(energy) + 1e-9, 6) AS energy, round(avg(entropy) + 1e-9, 6) AS entropy FROM per GROUP BY 1""",
    "plane_variance": f"WITH {_PX} SELECT image, round(var_pop(v) + 1e-9, 6) AS local_variance, round(avg(v) + 1e-9, 6) AS mean FROM px GROUP BY 1",
    "mad_by_group": f"WITH {_PX} SELECT label, round(median(v), 6) AS median, round(1.4826::DOUBLE * mad(v), 6) AS mad FROM px GROUP BY 1",
    "trimmed_mean": f"""
WITH {_PX}, r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) AS r, count(*) OVER (PARTITION BY label) AS n FROM px)
SELECT label, any_value(n) AS n, round(avg(v), 6) AS robust_mean FROM r WHERE r > CASE WHEN n < 3 THEN 0 ELSE floor(n * 0.1) END AND r <= n - CASE WHEN n < 3 THEN 0 ELSE floor(n * 0.1) END GROUP BY 1""",
    "local_z": f"WITH {_LZ} SELECT image, y::INT AS y, x, round(delta, 6) AS delta, round(z, 6) AS z FROM lz",
    "redness_measures": f"WITH {_LZ} SELECT image, round(avg((z >= 1.5)::INT), 6) AS affected_area_ratio, round(coalesce(median(CASE WHEN delta > 0 THEN delta END), 0), 6) AS median_positive_delta, round(quantile_cont(delta, 0.9), 6) AS p90_delta FROM lz GROUP BY 1",
    "unit_scale": f"""
WITH {_PX}, e AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px GROUP BY 1)
SELECT image, y::INT AS y, x, round(CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) AS unit FROM px JOIN e USING (image)""",
    "gray_world": f"""
WITH {_PX}, m AS (SELECT image, avg(v) FILTER (y <= 1) AS b, avg(v) FILTER (y BETWEEN 2 AND 4) AS g, avg(v) FILTER (y >= 5) AS r FROM px GROUP BY 1),
n AS (SELECT image, CASE WHEN (b + g + r) / 3 > 1e-6 THEN b / ((b + g + r) / 3) ELSE 1 END AS b, CASE WHEN (b + g + r) / 3 > 1e-6 THEN g / ((b + g + r) / 3) ELSE 1 END AS g, CASE WHEN (b + g + r) / 3 > 1e-6 THEN r / ((b + g + r) / 3) ELSE 1 END AS r FROM m)
SELECT image, round(greatest(abs(b - 1), abs(g - 1), abs(r - 1)), 6) AS deviation, round(b, 6) AS b, round(g, 6) AS g, round(r, 6) AS r FROM n""",
    "lr_asymmetry": f"""
WITH {_PX}, k AS (SELECT * FROM px WHERE v > 60 AND (image % 7 <> 0 OR x < 4)),
m AS (SELECT image, (min(x) + max(x)) // 2 AS mid, avg(v) AS mean FROM k GROUP BY 1),
s AS (SELECT image, avg(v) FILTER (x < mid) AS l, avg(v) FILTER (x >= mid) AS r, any_value(mean) AS mean, avg((v < 0.45::DOUBLE * mean)::INT) AS dark FROM k JOIN m USING (image) GROUP BY 1),
t AS (SELECT image, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN abs(l - r) / mean END AS a, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN dark END AS dk FROM s)
SELECT image, round(a, 6) AS asymmetry, round(dk, 6) AS dark_share, coalesce(a <= 0.12 AND dk <= 0.15, false) AS ok, coalesce(dk > 0.15, false) AS failed FROM t""",
    "deterministic_subsample": f"""
WITH {_PX}, r AS (SELECT image, y, x, v, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS r, count(*) OVER (PARTITION BY image) AS n FROM px WHERE v > 100)
SELECT image, y::INT AS y, x, v FROM r WHERE n <= 9 OR r IN (SELECT round_even(i * (n - 1) / 8.0::DOUBLE, 0)::INT FROM range(0, 9) g(i))""",
    "blur_drift": f"WITH {_DRIFT} SELECT image, label, laplacian_var, tenengrad, blurred, round(relative_drift, 6) AS relative_drift FROM drift",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM swept",
    "recommend_floor": f"WITH {_SWEEP} SELECT label, min(CASE WHEN p95_drift <= 0.88 THEN threshold END) AS floor FROM swept GROUP BY 1",
    "strictest_floor": f"WITH {_SWEEP}, f AS (SELECT label, min(CASE WHEN p95_drift <= 0.88 THEN threshold END) AS floor FROM swept GROUP BY 1) SELECT CASE WHEN count(floor) = count(*) THEN max(floor) END AS floor FROM f",
    "hull_membership": """
WITH pts AS (SELECT DISTINCT l_suppkey AS g, l_quantity AS x, l_linenumber::DOUBLE AS y, l_tax FROM lineitem),
h AS (SELECT DISTINCT g, unnest([min(x), max(x)]) AS x, y FROM pts WHERE l_tax <= 0.04 GROUP BY g, y), p AS (SELECT DISTINCT g, x, y FROM pts),
edges AS (
  SELECT a.g, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM h a JOIN h b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y) JOIN h c ON c.g = a.g
  GROUP BY ALL HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
    AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) BETWEEN 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))))
SELECT p.g, p.x, p.y FROM p JOIN edges e USING (g) GROUP BY ALL HAVING count(*) >= 3 AND bool_and((x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0) >= 0)""",
    "pair_asymmetry": f"""
WITH {st.REGIONS_SQL}, r AS (SELECT image, concern, quantity, substr(roi, 5, 1)::INT AS k FROM regions WHERE substr(roi, 5, 1)::INT >= 2)
SELECT a.image, a.concern, (a.k // 2)::VARCHAR AS roi, round(a.quantity, 6) AS "left", round(b.quantity, 6) AS "right", round(a.quantity - b.quantity, 6) AS asymmetry FROM r a JOIN r b ON a.image = b.image AND a.concern = b.concern AND a.k % 2 = 0 AND b.k = a.k + 1""",
    "run_lengths": f"WITH {_PX} SELECT image, y::INT AS y, min(x)::INT AS start, count(*) AS length FROM (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM px WHERE v > 110) GROUP BY image, y, g",
    "skin_consensus": f"""
WITH {_PX}, p AS (SELECT image, y // 2 AS patch, median(v) AS m FROM px GROUP BY 1, 2), c AS (SELECT image, median(m) AS c, mad(m) * 1.4826::DOUBLE AS s FROM p GROUP BY 1)
SELECT image, round(CASE WHEN count(*) >= 2 THEN median(m) END, 6) AS reference, count(*) AS n_patches FROM p JOIN c USING (image) WHERE s <= 1e-6 OR abs(m - c) <= 1.0 * s GROUP BY 1""",
    "color_lab": f"""
WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 151) % 256 AS b FROM part),
l AS (SELECT p_partkey, {_LIN("r")} AS r, {_LIN("g")} AS g, {_LIN("b")} AS b FROM c),
t AS (SELECT p_partkey, (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.950456 AS x, r * 0.212671 + g * 0.715160 + b * 0.072169 AS y, (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.088754 AS z FROM l),
q AS (SELECT p_partkey, CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END AS l, 500 * (({_F("x")}) - ({_F("y")})) AS a, 200 * (({_F("y")}) - ({_F("z")})) AS b FROM t),
k AS (SELECT p_partkey, round_even(least(greatest(l * 2.55, 0), 255), 0) * 100 / 255 AS l, round_even(least(greatest(a + 128, 0), 255), 0) - 128 AS a, round_even(least(greatest(b + 128, 0), 255), 0) - 128 AS b FROM q)
SELECT p_partkey, round(l, 4) AS l, a::DOUBLE AS a, b::DOUBLE AS b, round(sqrt(a * a + b * b), 6) AS chroma, round(l * 2.55, 4) AS luma FROM k""",
}
