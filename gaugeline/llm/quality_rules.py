"""Quality rules by line labelling: a linear-chain conditional random field, decoded by Viterbi.

Each line with a word is one position; its features are ratios over its bytes and words.
Viterbi's best sequence marks every line as content or boilerplate, and a document stays
if enough of its words stand in content lines. The weights come from ``train``: the
likelihood of line labels is raised by gradient ascent with forward-backward sums.
Labels of lines are taken from labelled documents: lines of documents of good quality are
content, those of the others boilerplate.

Defined results. A null, empty or blank text has no words, no lines, a content share of
0, and fails the base rules. Repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import _text

#: Base rules: fewest words; most percent of words in repeated windows; words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Least share of words in content lines.
LEAST_CONTENT = 0.5
#: Most labelled documents that the field is fitted on, each with all its lines.
SAMPLE_DOCS = 2000
#: Most bytes of these documents together (half for each quality); one of more than a sixteenth takes no part in the fit.
SAMPLE_BYTES = 32 << 20

FEATURES = ("bias", "symbols", "bars", "capitals", "shouts", "digits", "word_length", "few_words", "ends_sentence", "repeats", "long_words", "duplicate")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_IS = {name: np.isin(np.arange(256), [*chars]) for name, chars in {"bars": b"|", "capitals": bytes(range(65, 91)), "shouts": b"!?", "digits": b"0123456789", "stops": b".!?:;\"'"}.items()}


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


class Batch:
    """Counts and line features of some consecutive texts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        base = int(off[0])
        body, cut = raw[base : int(off[-1])], off - base
        n = len(body)
        h, starts, ends, first = _text.word_hashes(raw, off, lower=False)
        self.n_words = np.diff(first)
        solid = np.zeros(n + 1, np.int8)
        np.add.at(solid, starts, 1)
        np.add.at(solid, ends, -1)
        inside = np.cumsum(solid[:-1]).astype(bool)
        lead = (body & 0xC0) != 0x80
        chars, symbols = _sums(lead & inside), _sums(_SYMBOL[body])
        self.word_chars = chars[cut[1:]] - chars[cut[:-1]]
        self.n_symbols = symbols[cut[1:]] - symbols[cut[:-1]]
        self.n_repeat_words = self._repeats(h, first)

        # lines: from a text's start or behind a line feed
        feeds = np.flatnonzero(body == 10)
        begin = np.unique(np.concatenate([cut[:-1][np.diff(cut) > 0], feeds + 1]))
        begin = begin[begin < n] if n else begin[:0]
        owner = np.searchsorted(cut, begin, "right") - 1
        stop = np.append(begin[1:], n)
        a, b = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
        full = b > a  # lines with a word
        begin, stop, owner, a, b = begin[full], stop[full], owner[full], a[full], b[full]
        # the line itself ends before its line feed
        tail = stop - (body[stop - 1] == 10) if len(stop) else stop
        self.owner, self.words = owner, b - a
        size = np.maximum(chars[stop] - chars[begin], 1)
        ratio = {k: (s := _sums(m[body]))[stop] - s[begin] for k, m in _IS.items()}
        last = body[ends[b - 1] - 1] if len(b) else body[:0]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[2:] |= h[2:] == h[:-2]
        reps = _sums(same)
        text = body.tobytes()
        seen: set = set()
        dup = np.zeros(len(begin), bool)
        now = -1
        for k, (o, x, y) in enumerate(zip(owner.tolist(), begin.tolist(), tail.tolist(), strict=True)):
            if o != now:
                now, seen = o, set()
            line = text[x:y]
            dup[k] = line in seen
            seen.add(line)
        self.n_dup_lines = np.bincount(owner[dup], minlength=len(off) - 1)
        words = np.maximum(self.words, 1)
        mean = size / words
        self.features = np.stack(
            [
                np.ones(len(begin)),
                np.minimum((symbols[stop] - symbols[begin]) / words, 3) / 3,
                np.minimum(ratio["bars"] / words, 1),
                np.minimum(ratio["capitals"] / size * 2, 1),
                np.minimum(ratio["shouts"] / words, 1),
                np.minimum(ratio["digits"] / size * 4, 1),
                np.minimum(mean / 12, 1),
                words < 4,
                _IS["stops"][last],
                (reps[b] - reps[a]) / words if len(b) else np.zeros(0),
                mean > 12,
                dup,
            ],
            axis=1,
        ).astype(np.float64)

    def _repeats(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """By text, the words that stand in a window found twice or more in it."""
        win = _text.window_hashes(h, WINDOW)
        out = np.zeros(len(first) - 1, np.int64)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a <= WINDOW:
                continue
            own = win[a : b - WINDOW + 1]
            _, where, count = np.unique(own, return_inverse=True, return_counts=True)
            twice = count[where] > 1
            if twice.any():
                cover = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(twice)
                cover[at] += 1
                np.subtract.at(cover, at + WINDOW, 1)
                out[k] = int((np.cumsum(cover[:-1]) > 0).sum())
        return out


#: Weights by feature for boilerplate against content, and the transitions' scores [from][to]; 0 is content.
Weights = tuple[np.ndarray, np.ndarray]


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of a sequence; scores: those of boilerplate against content by line. Ties go to content."""
    n = len(scores)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    (cc, cb), (bc, bb) = move.tolist()
    c, b, back = 0.0, float(scores[0]), []
    for s in scores[1:].tolist():
        from_c, from_b = c >= b + bc - cc, c + cb >= b + bb  # the best way into content, into boilerplate
        back.append((0 if from_c else 1, 0 if from_b else 1))
        c, b = (c + cc if from_c else b + bc), (c + cb if from_b else b + bb) + s
    now = 0 if c >= b else 1
    out[-1] = now
    for k in range(n - 2, -1, -1):
        now = back[k][now]
        out[k] = now
    return out


def train(features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 1.0, ridge: float = 1e-3) -> Weights:
    """Weights that maximise the likelihood of the line labels, by forward-backward over all sequences at once."""
    order = sorted(range(len(features)), key=lambda i: -len(features[i]))
    size = np.array([len(features[i]) for i in order])
    # the longest sequence first, position by position: at position t stand the sequences that reach it, rows at[t] to at[t + 1]
    reach = np.searchsorted(-size, -np.arange(size[0]), "left")
    at = np.concatenate([[0], np.cumsum(reach)])
    seq = np.concatenate([np.arange(m) for m in reach])
    pos = np.repeat(np.arange(size[0]), reach)
    starts = np.concatenate([[0], np.cumsum(size)])
    rows = starts[seq] + pos
    x = np.concatenate([features[i] for i in order])[rows]
    y = np.concatenate([labels[i] for i in order])[rows].astype(np.int64)
    last = at[size - 1] + np.arange(len(size))
    here = np.arange(reach[0], len(seq))
    before = at[pos[here] - 1] + seq[here]
    w, move = np.zeros(len(FEATURES)), np.zeros((2, 2))
    lines = len(seq)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[before], y[here]), 1)
    spans = at.tolist()
    for _ in range(rounds):
        s = np.stack([np.zeros(lines), x @ w], axis=1)
        ahead, behind = np.zeros((lines, 2)), np.zeros((lines, 2))
        ahead[: reach[0]] = s[: reach[0]]
        for t in range(1, len(reach)):
            p, q, r = spans[t - 1], spans[t], spans[t + 1]
            was = ahead[p : p + r - q]
            ahead[q:r] = np.logaddexp(was[:, :1] + move[0], was[:, 1:] + move[1]) + s[q:r]
        for t in range(len(reach) - 2, -1, -1):
            p, q, r = spans[t], spans[t + 1], spans[t + 2]
            later = s[q:r] + behind[q:r]
            behind[p : p + r - q] = np.logaddexp(move[:, 0] + later[:, :1], move[:, 1] + later[:, 1:])
        total = np.logaddexp(ahead[last, 0], ahead[last, 1])[seq]
        p = np.exp(ahead[:, 1] + behind[:, 1] - total)
        both = ahead[before][:, :, None] + move + (s + behind)[here][:, None, :] - total[here][:, None, None]
        expected = np.exp(np.minimum(both, 0)).sum(axis=0)
        w += rate * ((y - p)[:, None] * x).sum(axis=0) / lines * 8 - rate * ridge * w
        move += rate * (seen - expected) / lines * 2 - rate * ridge * move
    return w, move


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``most`` labelled texts of at most ``most_bytes`` together, half of each quality where there are enough: those whose keys' hashes are smallest.

    A key whose labels contradict each other takes no part; of texts with one key the smallest does. A text of more than
    a sixteenth of the bytes takes no part in the fit (it is judged like any other).
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col(key).alias("key")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and key is not null")
    known = known.select("key", "quality", F.xxhash64("key").alias("h"))
    parts = [known.where(F.col("quality") == q).orderBy("h", "key").limit(most // 2) for q in (0, 1)]
    few = parts[0].union(parts[1])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key").where("text is not null")  # at most ``most`` rows
    rows = rows.groupBy("h", "key", "quality").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text"))
    w = Window.partitionBy("quality").orderBy("h", "key")  # at most ``most`` rows
    room = rows.where(F.col("size") <= most_bytes // 16).withColumn("upto", F.sum("size").over(w)).where(F.col("upto") <= most_bytes // 2)
    return [(r["text"], r["quality"]) for r in room.select("text", "quality").collect()]


def fit(texts: list[tuple[str, int]]) -> Weights:
    """Weights from texts with their quality; without both kinds, weights that mark no line."""
    if len({q for _, q in texts}) < 2:
        return np.zeros(len(FEATURES)), np.zeros((2, 2))
    texts = sorted(texts)
    col = pa.array([t for t, _ in texts], pa.large_string())
    b = Batch(*_text.column_bytes(col))
    xs, ys = [], []
    for k, (_, q) in enumerate(texts):
        f = b.features[b.owner == k]
        if len(f):
            xs.append(f)
            ys.append(np.full(len(f), 1 - q))
    return train(xs, ys)


def judged(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """By row of docs: the base counts, the content lines and words, the content share and the verdicts."""
    rows = docs.select(key, text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "n_content_words"]
    schema = T.StructType([rows.schema[key], *[T.StructField(c, T.LongType()) for c in names], T.StructField("content_share", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    w, move = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = _text.column_bytes(batch.column(1))
            parts: list[list[np.ndarray]] = []
            for i, j in _text.groups(off):
                b = Batch(raw, off[i : j + 1])
                n = j - i
                label = np.zeros(len(b.owner), np.int8)
                scores = b.features @ w
                stops = np.searchsorted(b.owner, np.arange(n + 1)).tolist()
                for x, y in zip(stops, stops[1:], strict=False):
                    if y > x:
                        label[x:y] = viterbi(scores[x:y], move)
                good = label == 0
                lines = np.diff(stops)
                good_lines = np.bincount(b.owner[good], minlength=n)
                good_words = np.bincount(b.owner[good], weights=b.words[good], minlength=n).astype(np.int64)
                share = good_words / np.maximum(b.n_words, 1)
                failed = (b.n_words < LEAST_WORDS) | (100 * b.n_repeat_words > MOST_REPEATED * b.n_words)
                parts.append([b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, lines, good_lines, good_words, share, failed, ~failed & (share >= least_content)])
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * (len(schema) - 1)
            kinds = [pa.int64()] * len(names) + [pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)
