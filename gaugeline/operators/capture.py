"""Capture quality: failures as an array of names, verdicts, exclusions and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import vocab

# Quality limits.
LIMITS = {
    "min_face_height_frac": 0.35, "min_face_px": 768, "canonical_px": 768, "max_faces": 1, "max_yaw": 15.0, "max_pitch": 15.0, "max_roll": 10.0,
    "min_laplacian_var": 120.0, "min_tenengrad": 60.0, "frame_laplacian_var": 15.0, "frame_tenengrad": 8.0, "min_luma": 60.0, "max_luma": 200.0, "max_clipped": 0.02, "clip_low": 2, "clip_high": 253,
    "max_specular": 0.08, "min_roi_visibility": 0.60, "max_beard": 0.30, "max_glasses": 0.20, "max_cast": 0.18, "max_asymmetry": 0.12, "shadow_luma": 0.45, "max_shadow": 0.15, "min_anchor_px": 90.0, "filter_ratio": 0.35,
}


def check_limits(limits: dict) -> None:
    """A face that passes must not need to be enlarged."""
    if limits["min_face_px"] < limits["canonical_px"]:
        raise ValueError("min_face_px is below the canonical width")


def blurry(lap: Column, ten: Column, lim: dict = LIMITS, frame: bool = False) -> Column:
    k = "frame_" if frame else "min_"
    return (lap < lim[f"{k}laplacian_var"]) | (ten < lim[f"{k}tenengrad"])


def named(*checks: tuple[Column, str]) -> Column:
    """The sorted distinct names of the checks that hold; an unknown check does not."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))))


def precheck(row: dict[str, Column], lim: dict = LIMITS) -> Column:
    """Failures that the whole frame shows, before any face is sought."""
    return named((row["cast"] > lim["max_cast"], "color_cast"), (blurry(row["frame_lap"], row["frame_ten"], lim, True), "blur"))


def failures(row: dict[str, Column], lim: dict = LIMITS) -> Column:
    """All failures of a capture; without a face only that one."""
    roi = F.array_max(F.map_values(row["visibility"]))
    glasses = (row["beard"] <= lim["max_beard"]) & (row["glasses"] > lim["max_glasses"])
    full = named(
        (row["n_faces"] > lim["max_faces"], "multiple_faces"),
        ((row["face_h"] / row["frame_h"] < lim["min_face_height_frac"]) | (row["face_w"] < lim["min_face_px"]), "face_too_small"),
        ((F.abs(row["yaw"]) > lim["max_yaw"]) | (F.abs(row["pitch"]) > lim["max_pitch"]) | (F.abs(row["roll"]) > lim["max_roll"]), "extreme_pose"),
        (blurry(row["lap"], row["ten"], lim), "blur"),
        ((row["luma"] < lim["min_luma"]) | (row["clipped_low"] > lim["max_clipped"]), "underexposed"),
        ((row["luma"] > lim["max_luma"]) | (row["clipped_high"] > lim["max_clipped"]), "overexposed"),
        (row["specular"] > lim["max_specular"], "overexposed"),
        (row["shadow"] > lim["max_shadow"], "shadow_asymmetry"),
        (row["cast"] > lim["max_cast"], "color_cast"),
        (F.coalesce(roi, F.lit(0.0)) < lim["min_roi_visibility"], "insufficient_roi_visibility"),
        ((row["beard"] > lim["max_beard"]) | glasses, "occlusion"),
    )
    return F.when(F.coalesce(row["n_faces"], F.lit(0)) < 1, F.array(F.lit("no_face"))).otherwise(full)


def glasses_metric(beard: Column, glasses: Column, lim: dict = LIMITS) -> Column:
    """Glasses are not measured once the beard has failed."""
    return F.when(beard <= lim["max_beard"], glasses)


def least_visibility(visible: Column, required: tuple[str, ...]) -> Column:
    """The least visible share of the required regions of a map, a missing one being 0; 0 if none is required."""
    shares = [F.coalesce(F.try_element_at(visible, F.lit(r)), F.lit(0.0)) for r in required]
    return F.array_min(F.array(*shares)) if shares else F.lit(0.0)


def with_scale_floor(found: Column, anchor: Column, lim: dict = LIMITS) -> Column:
    """The failures with face_too_small behind them if the anchor is too short; they are not sorted anew."""
    short = (anchor < lim["min_anchor_px"]) & ~F.array_contains(found, "face_too_small")
    return F.when(short, F.array_append(found, "face_too_small")).otherwise(found)


def verdict(found: Column, shadow_ok: Column) -> Column:
    """struct of booleans only."""
    none = lambda *names: ~F.arrays_overlap(found, F.array(*map(F.lit, names)))
    return F.struct(
        (F.size(found) == 0).alias("passed"),
        none("blur").alias("blur_pass"),
        none("underexposed", "overexposed").alias("exposure_pass"),
        none("color_cast").alias("color_pass"),
        none("extreme_pose").alias("pose_pass"),
        shadow_ok.alias("shadow_pass"),
    )


def excluded(areas: DataFrame, by: list[str], floors: dict[str, float], default: float, least_visibility: float) -> DataFrame:
    """areas (by..., roi, area, visibility, anchor) with ``unusable``; an unusable region has no area and no visibility left."""
    floor = F.coalesce(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])[F.col("roi")] if floors else F.lit(None), F.lit(default))
    bad = (F.col("area") < floor * F.col("anchor") * F.col("anchor")) | (F.col("visibility") < least_visibility)
    return areas.withColumn("unusable", bad).withColumns({"area": F.when(bad, 0).otherwise(F.col("area")), "visibility": F.when(bad, 0.0).otherwise(F.col("visibility"))})


def measurable(areas: DataFrame, captures: DataFrame, primary: DataFrame, least: int) -> DataFrame:
    """(image, concern, roi, reason) of every primary region; a null reason is usable."""
    every = captures.select("image").join(F.broadcast(primary.select("concern", "roi").withColumn("one", F.lit(1))), F.lit(True))  # a fixed list
    rows = every.drop("one").join(areas.select("image", "roi", "area"), ["image", "roi"], "left")
    return rows.select("image", "concern", "roi", F.when(F.col("area").isNull() | (F.col("area") == 0), "absent").when(F.col("area") < least, "below_floor").alias("reason"))


def concern_refusal(concern: Column, v: Column) -> Column:
    """Why a concern is not measured on a capture, from its verdict; null if it is."""
    exposure = F.when(~v["exposure_pass"], "exposure")
    return (
        F.when((concern == "redness") & ~v["color_pass"], "color_cast")
        .when((concern == "dark_spots") & ~v["shadow_pass"], "shadow_asymmetry")
        .when(concern.isin("dark_spots", "texture", "wrinkles"), exposure)
    )


def result_rows(spark, image: Column, enabled: set[str], disabled: set[str]) -> DataFrame:
    """(concern, severity): disabled concerns are disabled without a look at pixels; enabling one without a module is refused."""
    if missing := (enabled - set(vocab.ENABLED)):
        raise ValueError(f"no module for {sorted(missing)}")
    return vocab.small_table(spark, "concern string,severity string", [(c, "unmeasurable") for c in sorted(enabled)] + [(c, "disabled") for c in sorted(disabled)])


def client_reasons(row: dict[str, Column]) -> Column:
    """The client's hints: size, light, cast, and with a detected face its size, roll, turn and sharpness, else the centre crop's sharpness. Without a detector nothing about the face can fail."""
    face = F.coalesce(row["detected"], F.lit(False))
    sharp = F.when(face, blurry(row["face_lap"], row["face_ten"])).otherwise(blurry(row["centre_lap"], row["centre_ten"], frame=True))
    return named(
        (row["long_edge"] < 900, "too_small"),
        (row["luma"] < LIMITS["min_luma"], "too_dark"),
        (row["luma"] > LIMITS["max_luma"], "too_bright"),
        (F.greatest(row["clipped_low"], row["clipped_high"]) > LIMITS["max_clipped"], "clipped"),
        (row["cast"] > LIMITS["max_cast"], "color_cast"),
        (face & (row["face_px"] < LIMITS["min_face_px"]), "face_too_small"),
        (face & (F.abs(row["roll"]) > 10), "tilted"),
        (face & (F.abs(row["yaw_proxy"]) > 0.35), "turned"),
        (sharp, "blur"),
    )
