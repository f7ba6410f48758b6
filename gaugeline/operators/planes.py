"""Small image planes as arrays of numbers: stencils, co-occurrence and colour, in DataFrame functions.

A plane is one row: image, w, h and ``plane``, the values row by row. Stencils index the array, so a
plane is never spread over rows or shuffled; pixels(), for relational work, is one explode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import robust


def pixels(planes: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., y, x, v)"""
    return planes.select(*keep, "w", F.posexplode("plane").alias("p", "v")).select(*keep, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), "v")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns worked out once.

    Spark copies a column's expression to where it is used; inside a function over an array that
    would work it out again for every element. What a generator puts out is not copied.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def _mirrored(k: Column, n: Column) -> Column:
    """An index outside 0..n-1 mirrored about the border pixel."""
    k = F.abs(k)
    return F.when(k >= n, 2 * n - 2 - k).otherwise(k)


def at(plane: Column, w: Column, h: Column, y: Column, x: Column) -> Column:
    return F.get(plane, (_mirrored(y, h) * w + _mirrored(x, w)).cast("int"))


def stencil(plane: Column, w: Column, h: Column, weights: dict[tuple[int, int], float], interior: bool = False) -> Column:
    """The weighted sum of each pixel's neighbours at (dy, dx): borders are mirrored, or left out."""

    def one(i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        out = F.lit(0.0)
        for (dy, dx), k in weights.items():
            out = out + at(plane, w, h, y + dy, x + dx) * k
        return out

    every = F.sequence(F.lit(0), w * h - 1)
    if interior:
        every = F.filter(every, lambda i: (i % w > 0) & (i % w < w - 1) & (i >= w) & (i < w * (h - 1)))
    return F.transform(every, one)


# The Laplacian and Sobel weights.
LAPLACIAN = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}
SOBEL_X = {(-1, -1): -1.0, (-1, 1): 1.0, (0, -1): -2.0, (0, 1): 2.0, (1, -1): -1.0, (1, 1): 1.0}
SOBEL_Y = {(x, y): k for (y, x), k in SOBEL_X.items()}
BOX = {(y, x): 1 / 9 for y in (-1, 0, 1) for x in (-1, 0, 1)}


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def variance_of(a: Column) -> Column:
    """Population variance of an array."""
    m = mean_of(a)
    return mean_of(F.transform(a, lambda v: (v - m) * (v - m)))


def with_focus(planes: DataFrame, interior: bool = False) -> DataFrame:
    """planes with laplacian_var and tenengrad; interior leaves the border pixels out."""
    w, h, p = F.col("w"), F.col("h"), F.col("plane")
    out = settled(planes, "plane").withColumns({"__l": stencil(p, w, h, LAPLACIAN, interior), "__x": stencil(p, w, h, SOBEL_X, interior), "__y": stencil(p, w, h, SOBEL_Y, interior)})
    out = settled(out, "__l", "__x", "__y")
    out = settled(out.withColumn("__m", mean_of(F.col("__l"))), "__m")
    var = mean_of(F.transform("__l", lambda v: (v - F.col("__m")) * (v - F.col("__m"))))
    ten = mean_of(F.zip_with("__x", "__y", lambda a, b: a * a + b * b))
    return out.withColumns({"laplacian_var": var, "tenengrad": ten}).drop("__l", "__x", "__y", "__m")


def with_gradient_energy(planes: DataFrame, anchor: float) -> DataFrame:
    """planes with gradient_energy: the mean gradient for each anchor length."""
    w, h, p = F.col("w"), F.col("h"), F.col("plane")
    both = settled(planes, "plane").withColumns({"__x": stencil(p, w, h, SOBEL_X), "__y": stencil(p, w, h, SOBEL_Y)})
    return both.withColumn("gradient_energy", mean_of(F.zip_with("__x", "__y", lambda a, b: F.hypot(a, b))) * anchor).drop("__x", "__y")


def offsets(distances: list[int], angles: tuple[float, ...] = (0, 45, 90, 135)) -> list[tuple[int, int]]:
    """(dy, dx) of each distinct distance and angle, rounded half to even."""
    return [(round(math.sin(math.radians(a)) * d), round(math.cos(math.radians(a)) * d)) for d in sorted(set(distances)) for a in angles]


def glcm(planes: DataFrame, keep: list[str], steps: list[tuple[int, int]], levels: int = 64, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """(keep..., contrast, homogeneity, energy, entropy): means over the offsets of symmetric, normed co-occurrence matrices of fixed range."""
    q = F.transform("plane", lambda v: F.least(F.greatest((v - low) * (levels / (high - low)), F.lit(0.0)), F.lit(float(levels - 1))).cast("int"))
    rows = settled(planes.select(*keep, "w", "h", q.alias("q")), "q").select(*keep, "w", "h", "q", F.posexplode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("o", "s"))
    w, h = F.col("w"), F.col("h")
    fits = F.filter(F.sequence(F.lit(0), w * h - 1), lambda i: (F.floor(i / w) + F.col("s.dy")).between(0, h - 1) & (i % w + F.col("s.dx")).between(0, w - 1))
    rows = settled(rows.withColumn("fits", fits), "fits")
    pairs = F.transform("fits", lambda i: F.struct(F.get("q", i.cast("int")).alias("i"), F.get("q", (i + F.col("s.dy") * w + F.col("s.dx")).cast("int")).alias("j")))
    both = F.concat(pairs, F.transform(pairs, lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))))
    cells = rows.select(*keep, "o", (2 * F.size("fits")).alias("n"), F.explode(both).alias("p")).groupBy(*keep, "o", "n", "p.i", "p.j").agg(F.count("*").alias("c"))
    p, d = F.col("c") / F.col("n"), (F.col("i") - F.col("j")).cast("double")
    per = cells.groupBy(*keep, "o").agg(F.sum(p * d * d).alias("contrast"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(p * p)).alias("energy"), F.sum(-p * F.log2(p)).alias("entropy"))
    return per.groupBy(*keep).agg(*[F.avg(x).alias(x) for x in ("contrast", "homogeneity", "energy", "entropy")])


def local_z(px: DataFrame, by: list[str], x: str = "v", eps: float = 1e-6) -> DataFrame:
    """px with delta and z against its own region's median and scaled MAD."""
    stats = robust.medians_and_mads(px, by, x)
    out = px.join(F.broadcast(stats) if not by else stats, by)
    return out.withColumn("delta", F.col(x) - F.col("median")).withColumn("z", F.col("delta") / (robust.scaled_mad(F.col("mad")) + eps)).drop("median", "mad")


def luminance(lightness: Column) -> Column:
    """Lightness 0..100 on a fixed scale of 255."""
    return lightness * 2.55


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of 8-bit sRGB under D65, quantised to 8 bits as stored, then rescaled."""
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    x = (lin(r) * 0.412453 + lin(g) * 0.357580 + lin(b) * 0.180423) / 0.950456
    y = lin(r) * 0.212671 + lin(g) * 0.715160 + lin(b) * 0.072169
    z = (lin(r) * 0.019334 + lin(g) * 0.119193 + lin(b) * 0.950227) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    lum = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    byte = lambda v: F.bround(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)), 0)
    return F.struct((byte(lum * 2.55) * 100 / 255).alias("l"), (byte(500 * (f(x) - f(y)) + 128) - 128).alias("a"), (byte(200 * (f(y) - f(z)) + 128) - 128).alias("b"))


def gray_world(b: Column | str, g: Column | str, r: Column | str) -> Column:
    """struct(deviation, b, g, r): each channel's mean over the mean of all, and the largest distance from 1; a black image has none."""
    means = [F.avg(c) for c in (b, g, r)]
    over = (means[0] + means[1] + means[2]) / 3
    parts = [F.when(over > 1e-6, m / over).otherwise(1.0) for m in means]
    return F.struct(F.greatest(*[F.abs(p - 1) for p in parts]).alias("deviation"), *[p.alias(n) for p, n in zip(parts, "bgr", strict=True)])


def sides(px: DataFrame, by: list[str], x: str = "v", max_asymmetry: float = 0.12, dark: float = 0.45, max_dark: float = 0.15) -> DataFrame:
    """(by..., asymmetry, dark_share, ok, failed) of a masked plane's left and right halves.

    Halves part at the truncated middle of the mask's columns. A mask on one side only is not ok, without numbers.
    """
    mid = px.groupBy(*by).agg(F.floor((F.min("x") + F.max("x")) / 2).alias("mid"), F.avg(x).alias("mean"))
    rows = px.join(mid, by)
    left = F.col("x") < F.col("mid")
    out = rows.groupBy(*by).agg(F.avg(F.when(left, F.col(x))).alias("l"), F.avg(F.when(~left, F.col(x))).alias("r"), F.first("mean").alias("mean"), F.avg((F.col(x) < dark * F.col("mean")).cast("double")).alias("dark"))
    two = F.col("l").isNotNull() & F.col("r").isNotNull()
    asym = F.when(two, F.abs(F.col("l") - F.col("r")) / F.col("mean"))
    out = out.select(*by, asym.alias("asymmetry"), F.when(two, F.col("dark")).alias("dark_share"))
    return out.withColumns({"ok": F.coalesce((F.col("asymmetry") <= max_asymmetry) & (F.col("dark_share") <= max_dark), F.lit(False)), "failed": F.coalesce(F.col("dark_share") > max_dark, F.lit(False))})


def consensus(patches: DataFrame, by: list[str], outlier: float = 3.0, least: int = 2) -> DataFrame:
    """(by..., reference, n_patches): the median of the patches' medians that lie within so many MADs of the consensus; null with too few.

    patches: (by..., patch, median).
    """
    c = robust.medians_and_mads(patches, by, "median").withColumnsRenamed({"median": "c", "mad": "spread"})
    near = (robust.scaled_mad(F.col("spread")) <= 1e-6) | (F.abs(F.col("median") - F.col("c")) <= outlier * robust.scaled_mad(F.col("spread")))
    kept = patches.join(c, by).where(near)
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.median("median").alias("m")).select(*by, F.when(F.col("n") >= least, F.col("m")).alias("reference"), F.col("n").alias("n_patches"))
