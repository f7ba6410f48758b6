"""Queries over whole planes by the vectorised kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import images
from gaugeline.plans.q_planes import _PX, _planes


def plane_components(s, d):
    """8-connected groups of pixels at 140 or more, with area and first pixel."""
    c = images.components(_planes(s, d).select("image", "w", "h", "plane"), 140.0)
    return c.select("image", "area", "y", "x")


def largest_component(s, d):
    c = plane_components(s, d)
    return c.groupBy("image").agg(F.max(F.struct("area", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m")).select("image", "m.area", (-F.col("m.ny")).alias("y"), (-F.col("m.nx")).alias("x"))


def plane_spectrum(s, d):
    out = images.spectrum(_planes(s, d).select("image", "w", "h", "plane"), 1, 3)
    return out.select("image", F.round("hf_ratio", 6).alias("hf_ratio"))


def plane_blur_sweep(s, d):
    out = images.blur_sweep(_planes(s, d).select("image", "w", "h", "plane"), (0.5, 1.0, 1.5))
    return out.select("image", "sigma", F.round("laplacian_var", 4).alias("laplacian_var"), F.round("tenengrad", 4).alias("tenengrad"))


QUERIES = {f.__name__: f for f in (plane_components, largest_component, plane_spectrum, plane_blur_sweep)}

_CC = f"""RECURSIVE {_PX}, m AS (SELECT image, y::INT AS y, x, y * 8 + x AS id FROM px WHERE v >= 140),
walk AS (SELECT image, id, y, x, id AS root FROM m UNION SELECT m.image, m.id, m.y, m.x, w.root FROM walk w JOIN m ON m.image = w.image AND abs(m.y - w.y) <= 1 AND abs(m.x - w.x) <= 1),
lab AS (SELECT image, id, min(root) AS root FROM walk GROUP BY 1, 2),
comp AS (SELECT image, root, count(*) AS area FROM lab GROUP BY 1, 2)"""

SQL = {
    "plane_components": f"WITH {_CC} SELECT image, area, (root // 8)::INT AS y, (root % 8)::INT AS x FROM comp",
    "largest_component": f"WITH {_CC} SELECT image, area, (root // 8)::INT AS y, (root % 8)::INT AS x FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, root) AS r FROM comp) WHERE r = 1",
    "plane_spectrum": f"""
WITH {_PX}, mean AS (SELECT image, avg(v) AS m FROM px GROUP BY 1),
p AS (SELECT px.image, y, x, (v - m) * (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) AS v FROM px JOIN mean USING (image)),
f AS (SELECT image, ky.k AS ky, kx.k AS kx, sum(v * cos(2 * pi() * (ky.k * y + kx.k * x) / 8)) AS re, sum(v * sin(2 * pi() * (ky.k * y + kx.k * x) / 8)) AS im FROM p, range(-4, 4) ky(k), range(-4, 4) kx(k) GROUP BY 1, 2, 3)
SELECT image, round(sum(CASE WHEN sqrt(ky * ky + kx * kx) BETWEEN 1 AND 3 THEN re * re + im * im ELSE 0 END) / sum(re * re + im * im), 6) AS hf_ratio FROM f GROUP BY 1""",
}
