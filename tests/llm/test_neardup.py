import random
import re

import pytest

from gaugeline.llm import neardup
from gaugeline.llm._store import Store
from gaugeline.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """By id: the smallest id reachable by links between any of the ids' texts."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def check(spark, rows, schema, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], schema)
    got = neardup.near_duplicates(df, **kw).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(shingles(t))) for i, t in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])


def varied(seed, n, groups):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    bases = [[r.choice(vocab) for _ in range(r.choice([4, 30, 80, 200]))] for _ in range(groups)]
    out = []
    for i in range(n):
        w = r.choice(bases).copy()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((i * 3 + 1, " ".join(w)))
    return out


def test_odd_rows(spark, odd_rows, docs_schema):
    check(spark, [(i, t) for i, t, *_ in odd_rows], docs_schema)


def test_equals_brute_force(spark, docs_schema):
    check(spark, varied(1, 400, 25), docs_schema)


def test_an_id_with_several_texts_is_one_node(spark, docs_schema):
    r = random.Random(3)
    a, b, c, d = (" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(30)) for _ in range(4))
    check(spark, [(3, a), (5, a), (5, b), (9, b), (11, c)], docs_schema)
    check(spark, [(9, a), (7, a), (7, b), (8, b), (8, c), (2, c), (2, ""), (4, d), (None, d), (6, d + " more"), (6, None)], docs_schema)
    rows = varied(5, 120, 30)
    check(spark, rows + [(i, t) for (i, _), (_, t) in zip(r.sample(rows, 40), r.sample(rows, 40), strict=True)], docs_schema, unit_nodes=6)


def test_clusters_of_a_large_component_meet(spark, docs_schema):
    """Two groups around their own centres, and texts between them that are similar to none of the centres."""
    r = random.Random(6)
    vocab = [f"w{k}" for k in range(4000)]
    base = [r.choice(vocab) for _ in range(160)]
    far = base[:125] + [r.choice(vocab) for _ in range(35)]
    rows = []
    for i in range(160):
        w = (base if i % 2 else far).copy()
        for _ in range(i % 4):
            w[r.randrange(160)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(200 + k, " ".join(base[: 125 + 2 * k] + far[125 + 2 * k :])) for k in range(18)]
    for unit in (4, 12):
        check(spark, rows, docs_schema, unit_nodes=unit)


def test_blocks_of_a_large_component_lose_no_link(spark, docs_schema):
    """Units of eight nodes: every component of more is met in pairs of blocks."""
    check(spark, varied(2, 250, 3), docs_schema, unit_nodes=8)


def test_empty_table(spark, docs_schema):
    assert neardup.near_duplicates(spark.createDataFrame([], docs_schema)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(5, 9), (9, 2), (2, 5), (7, 8), (None, 3), (8, 7)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Store(spark, "t")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(up)}


def test_the_pipeline_links_from_four_fifths_on(spark, docs_schema, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(21)
    rows = []
    for k, n in enumerate([60, 50, 45] * 8):  # one changed word: similarities 51/61 = 0.836, 41/51 = 0.804, 36/46 = 0.783
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: n // 2], "changed", *words[n // 2 + 1 :]]))]
    sets = [shingles(t) for _, t in rows]
    gone = {j for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], docs_schema)
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect()}
    assert kept == set(range(len(rows))) - gone and len(gone) == 16
