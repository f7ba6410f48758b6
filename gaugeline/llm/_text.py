"""Vectorised word and shingle hashing shared by the text operators.

Everything here works on the raw UTF-8 bytes of a column slice: no byte of a
multi-byte character is ASCII white space or A-Z, so lower-casing and word
splitting are byte look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 8 + 5 & (2**64 - 1)
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEN_INT = 0x9E3779B97F4A7C15
_LEN = np.uint64(_LEN_INT)
_MASK = 2**64 - 1

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy; a null counts as empty."""
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.string()), np.int32
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def groups(off: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, by one running sum over all."""
    n = len(body)
    up, down = _power_tables(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * up, out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LEN)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: every word's hash, start and end byte (from off[0]), and each text's first word number (one more at the end)."""
    base, end = int(off[0]), int(off[-1])
    low = _LOWER[raw[base:end]] if lower else raw[base:end]
    n = len(low)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[off - base] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, off - base)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width neighbouring words (of all texts together)."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, width * _LEN_INT & _MASK, np.uint64)
    for k in range(width):
        acc += h[k : k + m] * _STEP[k]
    return mix64(acc)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """The hash of a whole sequence that is shorter than a window."""
    return mix64((h * _STEP[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(h) * _LEN_INT & _MASK], np.uint64))[0]


def shingle_sets_of(h: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text, given all words' hashes and each text's first word, its sorted distinct shingle hashes."""
    win = window_hashes(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(win[a : b - width + 1])
        elif b > a:
            yield np.array([sequence_hash(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: width words each; a shorter text is one shingle, an empty one has none."""
    h, _, _, first = word_hashes(raw, off)
    yield from shingle_sets_of(h, first, width)
