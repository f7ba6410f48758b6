import hashlib
import math
import random
from fractions import Fraction

import pytest

from gaugeline.llm import mixing, topk

VEC = "vec_id long, embedding array<float>, label int"


def best(rows, k=5):
    ok = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        s = sorted((-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return {i: v for i, v in out.items() if v}


def check(spark, rows):
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {i: sorted(v) for i, v in got.items()} == best(rows)


def test_equals_brute_force(spark):
    r = random.Random(3)
    f = lambda: r.choice([r.uniform(-1, 1), 0.5, -0.25])
    check(spark, [(i, [f() for _ in range(6)], 0) for i in range(400)])


def test_ties_nulls_and_lengths(spark):
    same = [0.5, 0.25]
    rows = [(i, same, None) for i in range(120)] + [(200, None, 1), (201, [None, 1.0], 1), (202, [float("nan"), 1.0], 1), (None, same, 1), (250, [1.0, 2.0, 3.0], 1), (251, [1.0, 1.0, 1.0], 1), (300, [], 1), (7, same, 2), (350, [-300.0, 4000.0], None)]
    check(spark, rows)


def test_large_components_count(spark):
    """Finite components of any size: exact up to 64 bits, the nearest 64-bit number beyond."""
    rows = [(0, [1.0, 2.0], 0), (1, [2.0**51, 1.0], 0), (2, [1.0, 1.0], 0), (3, [-(2.0**60), 5.0], 0), (4, [2.0**45, -(2.0**40)], 0), (5, [3.0e38, 1.0], 0), (6, [-3.0e38, 3.0e38], 0), (7, [2.0**45, 0.0], 0)]
    rows += [(50, [2.0**41, -(2.0**41)], 0), (100, [1e38, 1e38], 0), (150, [-1.5, 0.25], 0), (8, [1.0, 1.0], 1)]
    check(spark, rows)
    df = spark.createDataFrame([(0, [1.7e308, 0.5]), (1, [1.0, 1.0]), (2, [-1.0, 1e-320])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0")).collect()]
    assert sorted(got) == [(1, 1, topk.MOST), (2, 2, -topk.MOST)]


def test_chunks_of_queries(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    check(spark, [(i * 25, [r.uniform(-1, 1) for _ in range(r.choice([3, 4]))], 0) for i in range(60)])


def test_nothing_to_find(spark):
    df = spark.createDataFrame([], VEC)
    assert topk.top_k(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], VEC)
    assert topk.top_k(one, one).count() == 0


def simulate(docs, weights, other, block):
    names = {**weights, mixing.OTHER: other}
    per = {}
    for i, s in docs:
        per.setdefault(s if s in weights else mixing.OTHER, []).append(("0" * 32 if i is None else hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
    blocks = {k: [v[a : a + block] for a in range(0, len(v), block)] for k, v in ((k, sorted(v, key=lambda x: (x[0], x[1] or -1))) for k, v in per.items())}
    out, slot, q = [], 0, 0
    while True:
        m = {k: max(0, min(names[k], len(b) - q * names[k])) for k, b in sorted(blocks.items())}
        if not (length := sum(m.values())):
            return out
        done = dict.fromkeys(m, 0)
        for t in range(length):
            k = min((-(-(done[k] + 1) * length // m[k]), n, k) for n, k in enumerate(m) if done[k] < m[k] and done[k] * length // m[k] <= t)[2]
            out += [(i, q * names[k] + done[k], slot, p) for p, (_, i) in enumerate(blocks[k][q * names[k] + done[k]])]
            done[k] += 1
            slot += 1
            # less than one block from the target share, in every prefix
            assert all(abs(done[x] - (t + 1) * m[x] / length) < 1 for x in m)
        q += 1


@pytest.mark.parametrize("block", [1, 4])
def test_mixture_equals_simulation(spark, docs_schema, block):
    r = random.Random(4)
    docs = [(i, r.choice(["a"] * 8 + ["b", "b", "c", "zz", None])) for i in range(300)] + [(None, "a"), (3, "a"), (3, "a")]
    weights = {"a": 3, "b": 2, "c": 7, "unused": 5}
    df = spark.createDataFrame([(i, None, None, s, None) for i, s in docs], docs_schema).withColumnRenamed("lang", "slot")
    got = mixing.mixed(df, weights, other=2, block=block).collect()
    key = lambda x: (x[2], x[3])
    assert sorted(((x.doc_id, x.block, x.slot, x.place) for x in got), key=key) == sorted(simulate(docs, weights, 2, block), key=key)


def test_mixing_edges(spark, docs_schema):
    assert mixing.mixed(spark.createDataFrame([], docs_schema), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([], docs_schema), {"a": 0})
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([], docs_schema), {"a": mixing.MOST_WEIGHT})
