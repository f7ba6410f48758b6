"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct words of a batch of texts stand in one array of symbols, linked to
their neighbours. An index maps each adjacent pair to all its positions. Active
pairs are taken in ascending order of rank; merging a pair joins all its
positions in the partition's batch at once and moves the positions of the pairs
to their left and right to the lists of the new pairs. A word is encoded once,
however often it occurs, and so is each chunk between white space.

Normalising and splitting follow the tokenizer file: NFC, white space runs to one
space, lower case by single characters, then the file's split expression, bytes to
symbols, and an end-of-word mark on each word's last symbol. Which characters compose, have
a lower case, or are letters or numbers differs between versions of Unicode, so for characters beyond ASCII the
library's own tables are asked, once for each chunk and character: no other module's tables agree
with it on all code points. Special tokens in a
text are found before normalising. Decoding joins tokens by one space, as the
library does for a file without a decoder.

One index spans the texts of a partition up to INDEX_CHARS characters and then starts anew, so that
memory does not grow with the partition; a word that was encoded is kept for the next.

Defined results: a null or empty text has no tokens and decodes to the empty
string; nothing is truncated or padded.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Chunks and words whose ids are kept from one batch to the next, and texts' characters that one index holds.
KEEP_CHUNKS, KEEP_WORDS, INDEX_CHARS = 150_000, 150_000, 2_000_000
#: UTF-8 bytes of texts that are encoded and sent back at a time, so that memory does not depend on the size of a batch; a longer text goes alone.
SLICE_BYTES = 2_000_000
#: Ids are below this, so that a pair is one number.
SPAN = 1 << 20


def byte_symbols() -> list[str]:
    """By byte, its printable symbol: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Kinds(dict):
    """By code point, itself in ASCII, else a letter, digit, space or mark that stands for its class; classes are asked for as they are met."""

    def __init__(self, kinds: list):
        self.kinds = kinds

    def __missing__(self, code: int) -> int:
        c = chr(code)
        out = code if code < 128 else ord(next((k for k, split in self.kinds if not split.pre_tokenize_str(c)), "!"))
        self[code] = out
        return out


class Encoder:
    """A tokenizer file's tables, and the index over words."""

    def __init__(self, spec: str | dict):
        import regex
        from tokenizers import Regex, normalizers, pre_tokenizers

        t = json.loads(spec) if isinstance(spec, str) else spec
        m = t["model"]
        if m["type"] != "BPE" or t.get("decoder") or m.get("dropout") or m.get("byte_fallback") or m.get("continuing_subword_prefix"):
            raise ValueError("this tokenizer needs features that the encoder does not have")
        self.vocab: dict[str, int] = m["vocab"]
        self.tail: str = m.get("end_of_word_suffix") or ""
        self.names: dict[int, str] = {i: s for s, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        lower = [x["type"] for x in t["normalizer"]["normalizers"]]
        if lower != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer normalises in another way")
        #: The library's tables: composed form and lower case, and the characters of a class.
        self._normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self._kinds = [(k, pre_tokenizers.Split(Regex(x), "removed")) for k, x in (("a", r"\p{L}"), ("0", r"\p{N}"), (" ", r"\s"))]
        self._kind_of = _Kinds(self._kinds)
        self._space = regex.compile(r"\s+")
        self._bytes = [self.vocab.get(s, -1) for s in byte_symbols()]
        self._tails = [self.vocab.get(s + self.tail, -1) for s in byte_symbols()]
        #: left id * SPAN + right id -> rank; by rank, left, right and merged id
        self.ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(m["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
            self.ranks.setdefault(self.vocab[a] * SPAN + self.vocab[b], rank)
        self._chunks: dict[str, bytes] = {}
        self._kept: dict[str, bytes] = {}
        # the split expression as it reads for ASCII text
        self._plain = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        #: Separators that str.split() takes for white space and the file does not.
        self._odd = regex.compile("[\x1c-\x1f]")

    def chunks(self, text: str) -> list[str]:
        """A text between runs of white space; no word reaches beyond one."""
        return text.split() if not self._odd.search(text) else self._space.sub(" ", text).split(" ")

    def words(self, chunk: str) -> list[str]:
        """A chunk's words, normalised."""
        if chunk.isascii():
            chunk = chunk.lower()
            return [chunk] if chunk.isalpha() else self._plain.findall(chunk)
        chunk = self._normal.normalize_str(chunk)
        # the split expression sees one ASCII character of the same class for each
        return [chunk[m.start() : m.end()] for m in self._plain.finditer(chunk.translate(self._kind_of))]

    def pieces(self, text: str) -> list[str | int]:
        """A text's chunks; a special token stands as its id."""
        if self._special is None or not self._special.search(text):
            return self.chunks(text)
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(text):
            out += self.chunks(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.chunks(text[at:])

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, packed as little-endian unsigned 32-bit integers, by one index over all of them."""
        sym: list[int] = []
        ends: list[int] = []
        for w in words:
            raw = w.encode()
            sym += [self._bytes[b] for b in raw[:-1]]
            sym.append(self._tails[raw[-1]])
            ends.append(len(sym))
        n = len(sym)
        after = list(range(1, n + 1))  # the next position in the word, or -1
        before = list(range(-1, n - 1))  # the one before, or -1
        start = 0
        for e in ends:
            after[e - 1], before[start] = -1, -1
            start = e
        rank_of, pairs = self.ranks.get, self.pairs
        where: dict[int, list[int]] = {}  # rank of a pair -> its positions
        for i, j in enumerate(after):
            if j >= 0 and (r := rank_of(sym[i] * SPAN + sym[j])) is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
        active = [*where]
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = pairs[rank]
            spots = where.pop(rank)
            spots.sort()  # left to right: of overlapping occurrences the first is joined
            left = new * SPAN
            for i in spots:
                if sym[i] != a or (j := after[i]) < 0 or sym[j] != b:
                    continue  # an occurrence that an earlier join has changed
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(left + sym[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                h = before[i]
                if h >= 0 and (r := rank_of(sym[h] * SPAN + new)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        heapq.heappush(active, r)
        flat = np.array(sym, np.int64)
        live = flat >= 0
        packed = flat[live].astype("<u4").tobytes()
        stops = (np.concatenate([[0], np.cumsum(live)])[[0, *ends]] * 4).tolist()
        return {w: packed[x:y] for w, x, y in zip(words, stops, stops[1:], strict=False)}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        special = {i: i.to_bytes(4, "little") for i in self.special.values()}
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= INDEX_CHARS):
                size += len(texts[upto] or "")
                upto += 1
            split = [self.pieces(t) if t else [] for t in texts[at:upto]]
            chunks, kept = self._chunks, self._kept
            every = set().union(*split) - special.keys()
            fresh = {c: self.words(c) for c in every - chunks.keys()}
            ids_of = self.encode_words(sorted(set().union(*fresh.values()) - kept.keys()))
            for w, ids in ids_of.items():
                if len(kept) < KEEP_WORDS:
                    kept[w] = ids
            spill: dict[str | int, bytes] = dict(special)  # what the full cache does not take
            find = lambda w, own=ids_of, kept=kept: own[w] if w in own else kept[w]
            for c, ws in fresh.items():
                ids = find(ws[0]) if len(ws) == 1 else b"".join(map(find, ws))
                if len(chunks) < KEEP_CHUNKS:
                    chunks[c] = ids
                else:
                    spill[c] = ids
            out += [b"".join([chunks[c] if c in chunks else spill[c] for c in cs]) for cs in split]
            at = upto
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens by one space, special ones too; an unknown id is left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join(self.names[i] for i in ids if i in self.names)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def load(path: str) -> str:
    """The tokenizer file's content, to go with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(spec)


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about SLICE_BYTES of text (a list's entries count 4 bytes)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        size = pc.multiply(pc.list_value_length(col), 4) if pa.types.is_list(col.type) else pc.binary_length(col)
        upto = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, done + SLICE_BYTES, "right")))
            yield b.slice(at, end - at)
            at, done = end, int(upto[end - 1])


def tokens_of(docs: DataFrame, path: str, text: str = "text", column: str = "ids", digest: str | None = None) -> DataFrame:
    """docs with ``ids array<int>`` of every whole text, and on request the SHA-256 of the text that they decode to; columns of these names are replaced."""
    import hashlib

    from pyspark.sql import types as T

    spec = docs.sparkSession.sparkContext.broadcast(load(path))  # bounded: one vocabulary file
    new = [column] + [digest] * (digest is not None)
    docs = docs.drop(*new)
    kinds = [T.StructField(column, T.ArrayType(T.IntegerType(), False), False)] + [T.StructField(c, T.StringType(), False) for c in new[1:]]
    schema = T.StructType([*docs.schema.fields, *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in _slices(batches, text):
            ids = enc.encode_batch(b.column(b.schema.get_field_index(text)).to_pylist())
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=off[1:])
            cols = [pa.ListArray.from_arrays(off, np.frombuffer(b"".join(ids), "<i4"))]
            if digest is not None:
                cols.append(pa.array([hashlib.sha256(enc.decode(unpacked(x)).encode()).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, schema)


def texts_of(docs: DataFrame, path: str, column: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the decoded text of an array of ids; null ids decode to the empty string."""
    from pyspark.sql import types as T

    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    docs = docs.drop(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in _slices(batches, column):
            got = [enc.decode(x or []) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, text])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encode, decode and digest in one pass."""
    import hashlib

    from pyspark.sql import types as T

    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(key, text)
    schema = T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in _slices(batches, text):
            texts = b.column(1)
            n, a, d = [], [], []
            for ids in enc.encode_batch(texts.to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(enc.decode(unpacked(ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, schema)
