"""Image headers as column expressions: type by magic numbers, width and height without decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Request limits.
MAX_BYTES, MAX_PIXELS, MIN_SIDE = 12_000_000, 50_000_000, 240
FORMATS = ("jpeg", "png", "webp")
BUDGET_P50_MS, BUDGET_P95_MS = 1500, 3000

# The JPEG markers that carry the frame's size, and those that stand without a length.
JPEG_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
JPEG_ALONE = frozenset({0x01, *range(0xD0, 0xDA)})


def _hex(c: Column, at: int, n: int) -> Column:
    """n bytes from the zero-based offset, in hexadecimal."""
    return F.hex(F.substring(c, at + 1, n))


def big_endian(c: Column, at: int, n: int) -> Column:
    return F.conv(_hex(c, at, n), 16, 10).cast("bigint")


def little_endian(c: Column, at: int, n: int) -> Column:
    out = big_endian(c, at, 1)
    for k in range(1, n):
        out = out + F.shiftleft(big_endian(c, at + k, 1), 8 * k)
    return out


def sniffed(c: Column) -> Column:
    """jpeg, png, webp, or null."""
    return (
        F.when(_hex(c, 0, 3) == "FFD8FF", "jpeg")
        .when(_hex(c, 0, 8) == "89504E470D0A1A0A", "png")
        .when((_hex(c, 0, 4) == "52494646") & (_hex(c, 8, 4) == "57454250"), "webp")
    )


def png_size(c: Column) -> Column:
    """struct(width, height), or null for a header that is cut short or does not start with its first chunk."""
    ok = (F.octet_length(c) >= 24) & (_hex(c, 12, 4) == "49484452")
    return F.when(ok, F.struct(big_endian(c, 16, 4).alias("width"), big_endian(c, 20, 4).alias("height")))


def webp_size(c: Column) -> Column:
    """struct(width, height) of the three kinds of first chunk, or null."""
    n, kind = F.octet_length(c), _hex(c, 12, 4)
    size = lambda w, h: F.struct(w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))
    bits = little_endian(c, 21, 4)
    return (
        F.when((kind == "56503858") & (n >= 30), size(little_endian(c, 24, 3) + 1, little_endian(c, 27, 3) + 1))
        .when((kind == "56503820") & (n >= 30) & (_hex(c, 23, 3) == "9D012A"), size(little_endian(c, 26, 2).bitwiseAND(0x3FFF), little_endian(c, 28, 2).bitwiseAND(0x3FFF)))
        .when((kind == "5650384C") & (n >= 25) & (_hex(c, 20, 1) == "2F"), size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
    )


def jpeg_frame(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the frame segment, found by its chain; None for a malformed chain."""
    if data is None or data[:2] != b"\xff\xd8":
        return None
    at, n = 2, len(data)
    while at + 1 < n:
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker in JPEG_ALONE:
            at += 2
        elif at + 4 > n or (length := int.from_bytes(data[at + 2 : at + 4])) < 2:
            return None
        elif marker in JPEG_FRAMES:
            return (int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])) if at + 9 <= n else None
        else:
            at += 2 + length
    return None


_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(_SIZE)
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    """The segment chain's steps depend on the data, so this one is a vectorised function."""
    found = [jpeg_frame(x) for x in data]
    return pd.DataFrame({"width": pd.Series([x and x[0] for x in found], dtype="Int64"), "height": pd.Series([x and x[1] for x in found], dtype="Int64")})


def limit_refusal(fmt: Column, width: Column, height: Column) -> Column:
    """The first limit that a header breaks: format, then pixels, then side; null if none."""
    return (
        F.when(fmt.isNull() | ~fmt.isin(*FORMATS) | width.isNull() | height.isNull(), "unsupported_image")
        .when(width.cast("bigint") * height.cast("bigint") > MAX_PIXELS, "image_too_large")
        .when(F.least(width, height) < MIN_SIDE, "image_too_small")
    )


def content_type_mismatch(fmt: Column, declared: Column) -> Column:
    """Whether a declared content type does not name the sniffed format; a blank one is no mismatch."""
    return F.coalesce((declared != "") & ~F.contains(declared, fmt), F.lit(False))


def outcome(n_bytes: Column, refusal: Column, unverified: Column, qc_passed: Column, publishable: Column) -> Column:
    """struct(status_code, outcome, reason) of a request; the order of the cases is the contract."""
    o = lambda code, name, reason: F.struct(F.lit(code).alias("status_code"), F.lit(name).alias("outcome"), (F.lit(reason).cast("string") if not isinstance(reason, Column) else reason).alias("reason"))
    return (
        F.when(n_bytes > MAX_BYTES, o(413, "rejected", "image_too_large"))
        .when(refusal == "image_too_large", o(413, "rejected", refusal))
        .when(refusal == "image_too_small", o(400, "rejected", refusal))
        .when(refusal == "unsupported_image", o(415, "rejected", refusal))
        .when(unverified, o(500, "rejected", "service_misconfigured"))
        .when(~qc_passed, o(200, "retake_required", None))
        .when(~publishable, o(503, "not_available", None))
        .otherwise(o(200, "analysis", None))
    )


def latency_flags(elapsed_ms: Column) -> Column:
    """struct(within_p50, within_p95): budgets are reported, never acted on."""
    return F.struct((elapsed_ms <= BUDGET_P50_MS).alias("within_p50"), (elapsed_ms <= BUDGET_P95_MS).alias("within_p95"))
