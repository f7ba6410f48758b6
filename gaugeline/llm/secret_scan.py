"""Secret scanning: an Aho-Corasick prefilter, anchored expressions near its hits, checksums last.

One automaton over all keywords reads a text once. Only where a keyword ends is
its kind's expression tried, anchored at the keyword, so the expressions never
search. Kinds that carry a checksum or a decodable part are kept only if that
part is right. ``hex`` has no keyword; runs of its sixteen characters are found by
one linear scan.

Defined results: a null or empty text has no spans; a repeated row is scanned on
its own and gives the same spans; other columns are ignored and passed through
under their names, except those that clash with the new ones, which the new ones
replace. Positions are code points, ends exclusive. Spans of one kind never
overlap; spans of different kinds may.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans with the same start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

# Keywords that open a secret, and the published shapes of tokens.
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_KEYS = ("akia",)
GITHUB_KEYS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_KEYS = ("npm_",)
JWT_KEYS = ("eyj",)
PEM_KEYS = ("-----begin ",)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")

_LOW = {i: i + 32 for i in range(65, 91)}


def crc62(body: str) -> str:
    """The six base-62 digits that close a checksummed token."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def _checked(m: re.Match) -> bool:
    return crc62(m[1][:30]) == m[1][30:]


def _decodable(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _armoured(m: re.Match) -> bool:
    try:
        return len(base64.b64decode("".join(m[2].split()), validate=True)) >= 16
    except (ValueError, binascii.Error):
        return False


#: By kind: keywords, anchored expression, the test that a match must pass.
RULES = {
    "assign": (ASSIGN_KEYS, _ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (ACCESS_KEYS, _ACCESS, lambda m: len(m[0]) >= 18),
    "github": (GITHUB_KEYS, _GITHUB, _checked),
    "npm": (NPM_KEYS, _NPM, _checked),
    "jwt": (JWT_KEYS, _JWT, _decodable),
    "pem": (PEM_KEYS, _PEM, _armoured),
}


def automaton():
    """Keywords, in lower case, each with its length and kind."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, (keys, _, _) in RULES.items():
        for key in keys:
            auto.add_word(key, (len(key), kind))
    auto.make_automaton()
    return auto


def scan(text: str, auto) -> list[tuple[int, int, str]]:
    """All (kind number, start, end) of a text as (start, kind number, end) order, with the kind's name last."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOW)
    out, past, hits = [], dict.fromkeys(RULES, 0), []
    for last, (n, kind) in auto.iter(low):
        hits.append((last + 1 - n, kind))
    hits.sort()  # keywords of different lengths end in another order than they start
    for start, kind in hits:
        if start < past[kind]:
            continue
        _, shape, ok = RULES[kind]
        if m := shape.match(text, start):
            past[kind] = m.end()
            if ok(m):
                out.append((start, KINDS.index(kind), m.end(), kind))
    out += [(m.start(), 2, m.end(), "hex") for m in _HEX.finditer(text)]
    out.sort()
    return [(s, e, kind) for s, _, e, kind in out]


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``spans array<struct<start int, end int, kind string>>`` for every whole text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    docs = docs.drop("spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(x, auto)] if x else [] for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "spans"])

    return docs.mapInArrow(run, schema).withColumn("spans", F.coalesce("spans", F.array().cast(span)))


def redacted(text, spans):
    """Column: the text with every span's characters replaced by one mark per run of overlapping spans."""
    from pyspark.sql import functions as F

    # state: the text so far and the code point up to which it is settled
    step = lambda s, x: F.when(
        x["end"] <= s["at"], s
    ).otherwise(
        F.struct(
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("[SECRET]"))).alias("out"),
            x["end"].alias("at"),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
