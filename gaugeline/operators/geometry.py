"""Landmark geometry as columns: distances, boxes, hulls and region constructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The iris centres and the number of landmarks of a full face.
IRIS = (468, 473)
FULL_FACE = 478


def anchor(points: Column) -> Column:
    """Distance between the iris centres of an array of points; null without a full face."""
    a, b = (points[i] for i in IRIS)
    return F.when(F.size(points) >= FULL_FACE, F.hypot(a["x"] - b["x"], a["y"] - b["y"]))


def first_face(faces: Column) -> Column:
    """The points of the first face found; null without one, or where it lacks the iris points that give the scale."""
    return F.when((F.size(faces) > 0) & (F.size(F.get(faces, F.lit(0))) > IRIS[0]), F.get(faces, F.lit(0)))


def face_box(points: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h): the whole pixels around all points, inside the frame."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, y0 = F.greatest(F.floor(F.array_min(xs)), F.lit(0)), F.greatest(F.floor(F.array_min(ys)), F.lit(0))
    x1, y1 = F.least(F.ceil(F.array_max(xs)), width), F.least(F.ceil(F.array_max(ys)), height)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(x1 - x0, F.lit(0)).alias("w"), F.greatest(y1 - y0, F.lit(0)).alias("h"))


def face_metrics(left: Column, right: Column, nose: Column) -> Column:
    """struct(roll in degrees, yaw_proxy) from the eyes' and the nose's points."""
    dx, dy = right["x"] - left["x"], right["y"] - left["y"]
    return F.struct(F.degrees(F.atan2(dy, dx)).alias("roll"), ((nose["x"] - (left["x"] + right["x"]) / 2) / F.nullif(F.hypot(dx, dy), F.lit(0.0))).alias("yaw_proxy"))


def hull(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x0, y0, x1, y1): the edges of each group's convex hull, counter-clockwise in x right, y up.

    Two points make an edge if no other point lies to its right. Corners are the leftmost or rightmost
    points at their height, so only those are paired: two for each of a group's heights.
    """
    p = points.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = p.groupBy(*by, "y").agg(F.array_distinct(F.array(F.min("x"), F.max("x"))).alias("ends")).select(*by, F.explode("ends").alias("x"), "y")
    a = p.withColumnsRenamed({"x": "x0", "y": "y0"})
    b = p.withColumnsRenamed({"x": "x1", "y": "y1"})
    pairs = a.join(b, by).where("x0 <> x1 or y0 <> y1")
    side = (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0"))
    along = (F.col("x1") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y") - F.col("y0"))
    length = (F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2
    # of points on one line the outermost two make the edge
    ok = (side > 0) | ((side == 0) & (along >= 0) & (along <= length))
    key = [*by, "x0", "y0", "x1", "y1"]
    return pairs.join(p, by).groupBy(*key).agg(F.every(ok).alias("ok")).where("ok").select(*key)


def inside_hull(points: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """points that lie on or inside their group's hull; a group without three edges holds nothing."""
    side = (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0"))
    key = [*by, "x", "y"]
    return points.join(edges, by).groupBy(*key).agg(F.every(side >= 0).alias("ok"), F.count("*").alias("n")).where("ok and n >= 3").select(*key)


def extruded(brow: Column, up: Column) -> Column:
    """A ring over the brow's points: the points, then the same points higher by ``up`` in reverse; y grows downwards."""
    raised = F.transform(F.reverse(brow), lambda p: F.struct(p["x"].alias("x"), (p["y"] - up).alias("y")))
    return F.concat(F.transform(brow, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), raised)


def lateral_patch(corner: Column, midline_x: Column, width: Column, height: Column) -> Column:
    """A box beside an eye's corner, away from the midline."""
    out = F.when(corner["x"] >= midline_x, width).otherwise(-width)
    at = lambda dx, dy: F.struct((corner["x"] + dx).alias("x"), (corner["y"] + dy).alias("y"))
    return F.array(at(F.lit(0.0), -height / 2), at(out, -height / 2), at(out, height / 2), at(F.lit(0.0), height / 2))


def band_between(upper: Column, lower: Column, near: float, far: float) -> Column:
    """The ring between two shares of the way from an upper to a lower line of points; empty if the lower is not below."""
    mix = lambda t: F.zip_with(upper, lower, lambda a, b: F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y")))
    below = F.forall(F.zip_with(upper, lower, lambda a, b: b["y"] > a["y"]), lambda x: x)
    ring = F.concat(mix(near), F.reverse(mix(far)))
    return F.when(below, ring).otherwise(F.slice(ring, 1, 0))


def paired(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., roi, left, right, asymmetry) of regions named left_X and right_X, where both are measured."""
    left = df.where(F.startswith("roi", F.lit("left_"))).select(*by, F.substring("roi", 6, 100).alias("part"), F.col(value).alias("left"))
    right = df.where(F.startswith("roi", F.lit("right_"))).select(*by, F.substring("roi", 7, 100).alias("part"), F.col(value).alias("right"))
    return left.join(right, [*by, "part"]).select(*by, F.col("part").alias("roi"), "left", "right", (F.col("left") - F.col("right")).alias("asymmetry"))


def symmetric(areas: DataFrame, pairs: list[tuple[str, str]], tolerance: float) -> DataFrame:
    """(image, symmetry_ok): whether all pairs are there and differ by no more than a share of the larger."""
    by_roi = F.map_from_entries(F.collect_list(F.struct("roi", F.col("area").cast("double"))))
    one = areas.groupBy("image").agg(by_roi.alias("m"))
    ok = F.lit(True)
    for a, b in pairs:
        x, y = F.try_element_at("m", F.lit(a)), F.try_element_at("m", F.lit(b))
        ok = ok & F.coalesce(F.abs(x - y) <= tolerance * F.greatest(x, y), F.lit(False))
    return one.select("image", ok.alias("symmetry_ok"))


def runs(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by..., start, length) of runs of neighbouring whole numbers: gaps and islands."""
    g = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return df.select(*by, at, g.alias("g")).groupBy(*by, "g").agg(F.min(at).alias("start"), F.count("*").alias("length")).drop("g")
