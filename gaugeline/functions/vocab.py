"""Domain words and prespecified numbers, and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity bands in order of rank, and the two states outside the order.
BANDS = ("not_detected", "mild", "moderate", "high")
OUTSIDE = ("unmeasurable", "disabled")

# Concerns by configuration key, and the value under which facts name them.
CONCERN_VALUES = {"redness": "redness", "pigmentation": "dark_spots", "texture": "texture", "wrinkles": "wrinkles", "fine_lines": "fine_lines", "acne": "acne", "pores": "pores"}
ENABLED = ("redness", "dark_spots", "texture", "wrinkles")

# Regions, and which of them a concern is measured in.
SPOT_REGIONS = ("forehead", "left_cheek", "right_cheek", "nose", "chin")
PRIMARY_REGIONS = {
    "redness": SPOT_REGIONS,
    "dark_spots": SPOT_REGIONS,
    "texture": ("forehead", "left_cheek", "right_cheek", "nose"),
    "wrinkles": ("forehead", "left_crows_feet", "right_crows_feet", "left_under_eye", "right_under_eye", "left_nasolabial", "right_nasolabial"),
}

# Quality failures a capture can be refused for.
FAILURES = ("blur", "underexposed", "overexposed", "face_too_small", "no_face", "multiple_faces", "extreme_pose", "shadow_asymmetry", "occlusion", "insufficient_roi_visibility", "suspected_filter_or_makeup", "color_cast")

# Bounds declared before any run.
CUTS = (0.5, 1.5, 2.5)
EPS, MAD_SCALE = 1e-6, 1.4826
COHORT_FLOOR, HOLDOUT = 200, 0.30
MIN_SLICE = 5
GATES = {"ordinal_agreement": 0.90, "roi_availability": 0.90, "rejection_rate": 0.35, "rejection_spread": 0.20, "exact": 0.70, "adjacent": 0.90, "agreement_spread": 0.15, "fairness_values": 2}
CV_BOUNDS = {"redness": 0.20, "dark_spots": 0.25, "texture": 0.15, "wrinkles": 0.35}


def rank(band: Column) -> Column:
    """0 to 3 for the bands; -1 for the states outside the order and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, BANDS)), band) - 1, F.lit(-1)).cast("int")


def from_rank(r: Column) -> Column:
    """The band of a rank, clamped to the order."""
    return F.element_at(F.array(*map(F.lit, BANDS)), (F.least(F.greatest(r, F.lit(0)), F.lit(len(BANDS) - 1)) + 1).cast("int"))


def detected(band: Column) -> Column:
    return rank(band) >= 1


def is_ordinal(band: Column) -> Column:
    return rank(band) >= 0


def to_band(z: Column, cuts: tuple[float, float, float] = CUTS) -> Column:
    """Left-closed bands; null stays null."""
    a, b, c = cuts
    if not a < b < c:
        raise ValueError(f"cuts must increase: {cuts}")
    return F.when(z.isNull(), F.lit(None)).when(z < a, BANDS[0]).when(z < b, BANDS[1]).when(z < c, BANDS[2]).otherwise(BANDS[3])


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few literal rows, without a trip through Python on the executors."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [x.split()[1] for x in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for n, k, v in zip(names, kinds, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def value_of_key(key: Column) -> Column:
    """Configuration key to fact value; null for an unknown concern, which callers refuse."""
    return F.create_map(*[F.lit(x) for kv in CONCERN_VALUES.items() for x in kv])[key]


def key_of_value(value: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in CONCERN_VALUES.items() for x in (v, k)])[value]


def region_table(spark: SparkSession) -> DataFrame:
    """(concern, roi, position) of the primary regions."""
    return small_table(spark, "concern string, roi string, position int", [(c, r, k) for c, rs in PRIMARY_REGIONS.items() for k, r in enumerate(rs)])
