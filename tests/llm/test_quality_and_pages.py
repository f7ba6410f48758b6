import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gaugeline.llm import html_extract, licences, quality_classifier, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    cover = {k + j for k in range(len(words) - 7) if n[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(words) < 20 or 100 * len(cover) > 30 * len(words)


def test_base_rules_equal_brute_force(spark, odd_rows, docs_schema):
    rows = odd_rows + [(60, "a b c d e f g h " * 3 + "\n\nx\n x\nx\n", None, None, None), (61, "ü€😀 # $\n" * 25, None, None, None)]
    got = quality_rules.judged(spark.createDataFrame(rows, docs_schema), (np.zeros(len(quality_rules.FEATURES)), np.zeros((2, 2)))).collect()
    want = Counter((i, *base(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judged(spark.createDataFrame([], docs_schema), (np.zeros(len(quality_rules.FEATURES)), np.zeros((2, 2)))).count() == 0


def test_viterbi_equals_every_sequence():
    r = np.random.default_rng(1)
    for n in range(1, 7):
        s, m = r.normal(size=n), r.normal(size=(2, 2))
        score = lambda y: sum(s[i] * y[i] for i in range(n)) + sum(m[y[i]][y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        every = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert abs(score(quality_rules.viterbi(s, m).tolist()) - max(map(score, every))) < 1e-9


def test_field_and_classifier_on_held_out_rows(spark, docs_schema):
    r = np.random.default_rng(2)
    vocab = ["river", "stone", "garden", "walks", "slowly", "under", "evening", "light", "and", "the"]
    good = lambda: "\n".join(" ".join(r.choice(vocab, 12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join("*** ".join(r.choice(vocab, 12)) + " $$$ |" for _ in range(4))
    rows = [(i, good() if i % 3 else bad(), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, docs_schema)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality_rules.fit(quality_rules.sample(docs, labels))
    assert {x.doc_id: x.kept for x in quality_rules.judged(docs, weights).collect()} == {i: i % 3 > 0 for i in range(300)}
    out = quality_classifier.classified(spark, docs, labels)
    assert {x.doc_id: x.drawn for x in out.collect()} == {i: i % 3 > 0 for i in range(300)}
    rows = quality_classifier.noisy(quality_classifier.weighed(docs, quality_classifier.fit(docs, labels)), "doc_id")
    few = rows.withColumn("drawn", quality_classifier.draw(rows, "doc_id", k=20).takes("doc_id")).collect()
    top = sorted((-x.gumbel, x.doc_id) for x in few if x.n_grams)[:20]
    assert {i for _, i in top} == {x.doc_id for x in few if x.drawn}


def test_the_draw_decides(spark):
    """By sorting all sums: ties by key, rows of one key and value together; weights near 0 are drawn by their noise."""
    r = np.random.default_rng(12)
    w = np.concatenate([r.normal(0, 1, 300), r.normal(40, 5, 100), r.normal(-40, 5, 100), [3.0] * 40])
    rows = [(int(i) if i % 97 else None, float(x), int(i % 50 != 3)) for i, x in enumerate(w)] + [(5, float(w[5]), 1)] * 30
    df = quality_classifier.noisy(spark.createDataFrame(rows, "doc_id long, log_weight double, n_grams long"), "doc_id").persist()
    tied = spark.createDataFrame([(i // 2 if i else None, 1.0, 1, 2.0) for i in range(40)] + [(99, 0.0, 1, 2.0 + 2**-50), (98, 0.0, 1, -1e9), (97, -1.0, 1, 1e9)], "doc_id long, log_weight double, n_grams long, gumbel double")
    for frame in (df, tied):
        every = sorted((x for x in frame.collect() if x.n_grams), key=lambda x: (-x.gumbel, x.doc_id is not None, x.doc_id or 0))
        for k in (None, 0, 1, 3, 17, 200, 10**6):
            n = sum(x.log_weight >= 0 for x in every) if k is None else k
            want = Counter(map(tuple, every[:n]))
            if 0 < n < len(every):  # the last one's equals come with it
                want = Counter(tuple(x) for x in every if (-x.gumbel, x.doc_id is not None, x.doc_id or 0) <= (-every[n - 1].gumbel, every[n - 1].doc_id is not None, every[n - 1].doc_id or 0))
            got = Counter(map(tuple, frame.where(quality_classifier.draw(frame, "doc_id", k).takes("doc_id")).collect()))
            assert got == want, k
    kept = df.where(quality_classifier.draw(df, "doc_id").takes("doc_id")).collect()
    assert any(x.log_weight < 0 for x in kept) and min(x.log_weight for x in kept) > -20
    assert {x.doc_id for x in df.where("log_weight > 20 and n_grams > 0").collect()} <= {x.doc_id for x in kept}


def test_samples_do_not_depend_on_order(spark, docs_schema):
    rows = [(k // 2, f"text {k} " * 3, "en", "s", 0) for k in range(60)] + [(40, "x" * 500, "en", "s", 0)]
    labels = [(k, k % 2, 0) for k in range(30)] + [(3, 0, 0), (3, 1, 0), (40, 1, 0), (None, 1, 0)]
    a, b = [(spark.createDataFrame(x, docs_schema), spark.createDataFrame(y, "doc_id long, quality int, toxic int")) for x, y in ((rows, labels), (rows[::-1], labels[::-1]))]
    small = [sorted(quality_rules.sample(*x, most=20, most_bytes=1600)) for x in (a, b)]
    assert small[0] == small[1] and len(small[0]) in (19, 20)
    assert all(t != "x" * 500 and not t.startswith("text 6 ") for t, _ in small[0])
    known = [sorted(map(tuple, quality_classifier.sample(*x, "doc_id", "text", 10).collect())) for x in (a, b)]
    assert known[0] == known[1] and len(known[0]) == 20


def test_classifier_counts_equal_brute_force():
    texts = ["One two. two", "", None, "a  a|a ÜX 12!!", "z" * 50]
    raw, off = quality_classifier._text.column_bytes(pa.array(texts, pa.string()))
    tokens = [re.findall(r"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (t or "").encode().decode("latin1")) for t in texts]
    g, own = quality_classifier.grams(raw, off)
    n = [len(t) + max(len(t) - 1, 0) + max(len(t) - 2, 0) for t in tokens]
    assert np.bincount(own, minlength=5).tolist() == n
    one = [quality_classifier.counts_of(pa.array([t], pa.string())) for t in texts]
    assert (sum(one) == quality_classifier.counts_of(pa.array(texts, pa.string()))).all() and (np.bincount(g, minlength=quality_classifier.BUCKETS) == sum(one)).all()


def test_classifier_without_labels(spark, odd_rows, docs_schema):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classified(spark, spark.createDataFrame(odd_rows, docs_schema).withColumnRenamed("lang", "gumbel"), none).collect()
    assert len(out) == len(odd_rows) and all(r.drawn == bool(r.text and r.text.strip()) for r in out)
    assert quality_classifier.classified(spark, spark.createDataFrame([], docs_schema), none).count() == 0


PAGE = """<html><head><title>T</title><style>p{x:y}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Home</a> Site</header><div id="mainMenu"><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div>
<div class="cookie-notice">We use cookies</div>{body}<div class="sidebar"><p>Other stuff that may be rather long as well, as you can see here.</p></div>
<section id="comments"><article class="comment"><p>I think this is a great article, thanks very much for all of the reading.</p></article></section><script>var t = "</p><p>no";</script><div class=footer>(c) me</div>"""
ARTICLE = '<h1>A &amp; B</h1><p>First <b>pa</b>ra&nbsp;with some text,\n going on &#233;.<div class="ad-slot">Buy</div><p>Second.<form>Name <input></form><ul><li>one<li>two</ul><p>x'
WANT = "A & B First para with some text, going on é. Second. one two x"


def test_article_text():
    for wrap in ("<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>'):
        assert html_extract.main_text(PAGE.replace("{body}", wrap.format(ARTICLE))) == WANT, wrap


def test_an_unclosed_advert_does_not_swallow_the_article():
    ad = '<body><div class="ad">Buy this<nav><ul><li><a href=x>go</a>'
    rest = '<section id="comments"><article><p>' + "A reader's long remark. " * 40 + "</article></section>"
    assert html_extract.main_text(f"{ad}<article><h1>T</h1><p>One.<p>Two and more.</article>{rest}") == "T One. Two and more."
    teaser = '<aside class="related"><article><p>Read on</article></aside>'
    assert html_extract.main_text(f'<body>{teaser}<div id="text"><p>The one real text of the page.<p>End.</div>{rest}') == "The one real text of the page. End."


def test_broken_pages(spark):
    cases = {None: "", "": "", " ": "", "plain text": "plain text", "<p>a<p>b": "a b", "a < b <c": "a < b", "<b": "", "<!-- x": "", "<script>x": "", '<p class="x>y': "y", "<p>&am": "&am", "<nav>x": ""}
    rows = [(k, "u", h) for k, h in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, text string, html string")
    got = {r.page_id: r.text for r in html_extract.extracted(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert len(html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 10)) == 4
    assert html_extract.main_text("<p>" + "long text " * 100000).startswith("long text long")


def dice(text, name):
    low = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    a, b = set(zip(low, low[1:], strict=False)), {tuple(x.split()) for x in licences.bigrams_of(licences.TEMPLATES[name])}
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0.0


def test_licences_equal_brute_force(spark, docs_schema):
    mit = licences.TEMPLATES["MIT"]
    texts = [None, "", "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0!\ny", "released   UNDER the mit licence", mit, mit.replace(", ", ",\n"), "intro words\n\n" + mit.replace(", ", ",\n") + "\n \nend", mit[:200], "word " * 5000, "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(2, texts[2], "", "", 0)]
    want = Counter()
    for i, t, *_ in rows:
        paragraphs = re.split("\n[ \t]*\n", t or "")
        units = [("line", k, u) for k, u in enumerate((t or "").split("\n"))]
        units += [("paragraph", k, u) for k, u in enumerate([p for p in paragraphs if "\n" in p.strip(" ")])] + ([("text", 0, t)] if len(paragraphs) > 1 else [])
        want.update((i, kind, k, n, round(dice(u, n), 9)) for kind, k, u in units for n in licences.TEMPLATES if dice(u, n) >= 0.8)
    got = licences.matches(spark.createDataFrame(rows, docs_schema).withColumnRenamed("lang", "licence")).collect()
    assert Counter((r.doc_id, r.kind, r.number, r.licence, round(r.dice, 9)) for r in got) == want and len(want) > 5
    assert licences.matches(spark.createDataFrame([], docs_schema)).count() == 0


def test_shards(spark, docs_schema):
    import zlib

    r = np.random.default_rng(3)
    texts = ["copy of a text " * 4] * 300 + ["t%d " % k * int(r.integers(1, 60)) for k in range(500)] + [None, "", None]
    rows = [(k if k % 50 else None, t, ["en", "de", None][k % 3], f"s{k % 4}", 1) for k, t in enumerate(texts)] + [(1, "é", "en", None, 0)] * 2
    got = sharding.sharded(spark.createDataFrame(rows, docs_schema), 16).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g)
    assert all(sorted(g.slot for g in v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    sums = [sum(g.size for g in v) for v in by.values()]
    assert max(sums) - min(sums) <= 4 * max(size(t) for _, t, *_ in rows)
    assert sharding.sharded(spark.createDataFrame([], docs_schema), 16).count() == 0
    one = sharding.sharded(spark.createDataFrame([(1, None, None, None, None)], docs_schema), 16).collect()
    assert [(g.size, g.slot) for g in one] == [(1, 0)]


def tree(points, shards):
    """By row number its shard, by sorting: points are (number, size, h, k2, r, coordinates)."""
    out, target, torn = {}, sum(p[1] for p in points) / shards, 0

    def cut(here, first, n):
        nonlocal torn
        if n == 1 or not here:
            out.update((p[0], first) for p in here)
            return
        widths = [max(p[5][d] for p in here) - min(p[5][d] for p in here) for d in range(3)]
        d = widths.index(max(widths))
        unsigned = lambda x: x % 2**64
        groups = {}
        for p in here:
            groups.setdefault((p[5][d], unsigned(p[2]), unsigned(p[3])), []).append(p)
        goal, below, above = sum(p[1] for p in here) * (n // 2) / n, [], []
        for _, rows in sorted(groups.items()):
            w = sum(p[1] for p in rows)
            if goal <= 0 or goal >= w:
                (below if goal > 0 else above).extend(rows)
            elif min(goal, w - goal) <= sharding.SLACK * target:
                (below if goal > w - goal else above).extend(rows)
            else:
                torn += len(rows) > 1
                for p in sorted(rows, key=lambda p: unsigned(p[4])):
                    (below if 2 * goal > p[1] else above).append(p)
                    goal -= p[1]
                w = 0
                goal = 0
            goal -= w
        cut(below, first, n // 2)
        cut(above, first + n // 2, n - n // 2)

    cut(points, 0, shards)
    return out, torn


def test_shards_equal_a_tree_by_sorting(spark, docs_schema, monkeypatch):
    r = np.random.default_rng(5)
    texts = ["copy of a text " * 4] * 900 + ["other " * 9] * 60 + ["t%d " % (k % 400) * int(r.integers(1, 60)) for k in range(600)] + [None, ""]
    rows = [(k if k % 50 else 7, t, ["en", "de", "fr"][k % 3], f"s{min(k % 9, 4)}", 1) for k, t in enumerate(texts)]
    seen = {}
    plain = sharding.assigned

    def watched(points, shards, store):
        seen["points"] = [(x.n, x["size"], x.h, x.k2, x.r, (x.d_size, x.d_source, x.d_lang)) for x in points.collect()]
        out = plain(points, shards, store)
        seen["shard"] = {x.n: x.shard for x in out.collect()}
        return out

    monkeypatch.setattr(sharding, "assigned", watched)
    docs = spark.createDataFrame(rows, docs_schema)
    for shards in (16, 5, 1):
        got = sharding.sharded(docs, shards).collect()
        want, torn = tree(seen["points"], shards)
        assert seen["shard"] == want and len(got) == len(rows)
        assert torn <= shards - 1 and (shards == 1 or torn >= 1)
    total = sum(len((t or "").encode()) + 1 for t in texts)
    assert {g.shard for g in sharding.sharded(docs, target_bytes=total // 7 + 1).collect()} == set(range(7))


def test_sections_beside_one_very_long_block():
    long, short = "x" * 9 + " ", "y" * 7 + " "
    for n in (50, 500, 50_000):
        a, b = (long * n).strip(), (short * 100).strip()
        assert html_extract.main_text(f"<body><div><section><p>{a}</p></section><section><p>{b}</p></section></div></body>") == f"{a} {b}"
        assert html_extract.main_text(f"<body><div><section><p>{b}</p></section><section><h2>T</h2><p>{a}</p></section><section><p>{b}</p><p>End.</p></section></div>") == f"{b} T {a} {b} End."
    a = (long * 500).strip()
    # linked blocks stay inside, and go around; a list of links does not widen
    links = "<ul><li><a href=1>One other page</a><li><a href=2>Two other pages</a></ul>"
    assert html_extract.main_text(f"<body><div>{links}</div><div><p>{a}</p><p><a href=3>Source</a></p><p>End.</p></div><div>{links}</div></body>") == f"{a} Source End."
    assert html_extract.main_text(f"<body><div>{links}<div><p>{a}</p><p>End.</p></div></div></body>") == f"{a} End."
    assert html_extract.main_text(f"<body>{links}</body>") == "One other page Two other pages"


def test_late_lines_reach_the_field():
    r = np.random.default_rng(6)
    vocab = ["river", "stone", "garden", "walks", "slowly", "under", "evening", "light", "and", "the"]
    plain = lambda n: [" ".join(r.choice(vocab, 8)).capitalize() + "." for _ in range(n)]
    late = lambda n: ["*** ".join(r.choice(vocab, 8)) + " $$$ |" for _ in range(n)]
    texts = [("\n".join(plain(int(r.integers(1, 150)))), 1) for _ in range(40)] + [("\n".join(plain(64) + late(int(r.integers(60, 200)))), 0) for _ in range(40)]
    w, move = quality_rules.fit(texts)
    lines = quality_rules.Batch(*quality_rules._text.column_bytes(pa.array(["\n".join(plain(100) + late(100))], pa.large_string()))).features
    assert quality_rules.viterbi(lines @ w, move)[100:].all() and w[quality_rules.FEATURES.index("symbols")] > 1


def test_training_equals_every_sequence():
    r = np.random.default_rng(8)
    fs = [r.random((n, len(quality_rules.FEATURES))) for n in (3, 1, 5, 4, 5)]
    ys = [r.integers(0, 2, len(f)) for f in fs]
    w, move = quality_rules.train(fs, ys, rounds=1)
    lines, g, m = sum(map(len, fs)), np.zeros(w.shape), np.zeros((2, 2))
    for f, y in zip(fs, ys, strict=True):
        every = [[k >> i & 1 for i in range(len(f))] for k in range(2 ** len(f))]
        score = np.exp([sum(f[i] @ w * s[i] for i in range(len(f))) + sum(move[s[i], s[i + 1]] for i in range(len(f) - 1)) for s in every])
        score /= score.sum()
        for i in range(len(f)):
            g += (y[i] - sum(q * s[i] for q, s in zip(score, every, strict=True))) * f[i]
        for i in range(len(f) - 1):
            m[y[i], y[i + 1]] += 1
            for q, s in zip(score, every, strict=True):
                m[s[i], s[i + 1]] -= q
    two = quality_rules.train(fs, ys, rounds=2)
    assert np.allclose(two[0], w + g / lines * 8 - 1e-3 * w) and np.allclose(two[1], move + m / lines * 2 - 1e-3 * move)


def test_threshold_weighs_good_documents_as_named():
    r = np.random.default_rng(4)
    x, good = np.concatenate([r.normal(0, 1, 200), r.normal(1.5, 1, 300)]), np.repeat([0, 1], [200, 300])
    cuts = {}
    for keep in (1.0, 3.0, quality_classifier.KEEP):
        score = lambda t: (x[good == 0] < t).mean() + keep * (x[good == 1] >= t).mean()  # noqa: B023, E731
        cuts[keep] = quality_classifier.threshold(x, good, keep)
        assert abs(score(cuts[keep]) - max(map(score, [-np.inf, *x]))) < 1e-9
    assert cuts[1.0] > cuts[3.0] > cuts[10.0] == quality_classifier.threshold(x, good)


def test_surge_and_dive_decide(monkeypatch):
    text = "One sentence of the article, as long as it is. " * 4
    links = "<div>" + "".join(f"<p><a href={k}>Another page {k}</a></p>" for k in range(4)) + "</div>"
    pages = {
        # words around an article that no mark tells apart
        f"<body><div>Our house</div><article><h1>T</h1><p>{text}</p><p>End.</p></article><div>Made by us, with care</div></body>": f"T {text.strip()} End.",
        # no article element: a run of links on either side
        f"<body><div>Our house</div>{links}<div><p>{text}</p><p>End.</p></div>{links}<div>Made by us</div></body>": f"{text.strip()} End.",
    }
    assert [html_extract.main_text(p) for p in pages] == list(pages.values())
    monkeypatch.setattr(html_extract, "surge_and_dive", lambda sizes, window=3: (0, len(sizes)))
    assert all(html_extract.main_text(p).startswith("Our house") and html_extract.main_text(p).endswith("us" if "Made by us<" in p else "with care") for p in pages)


def test_surge_and_dive_equals_plain_sums():
    r = np.random.default_rng(7)
    for _ in range(200):
        sizes = (r.integers(0, 5, int(r.integers(1, 30))) * (r.random() < 0.9) * r.integers(0, 2)).tolist()
        sums = [sum(sizes[k : k + 3]) for k in range(len(sizes))]
        peak = sums.index(max(sums))
        a = max([k + 1 for k in range(peak) if sums[k] == 0], default=0)
        b = min([k for k in range(peak + 1, len(sums)) if sums[k] == 0], default=len(sums))
        assert html_extract.surge_and_dive(sizes) == (a, b)


def test_deep_pages_take_time_in_proportion():
    import time

    deep = {"<div>x": 60_000, "<p><button><div>x": 30_000, "<article><ul><li>x": 30_000, "<b><p>x": 30_000}
    for part, n in deep.items():
        start = time.monotonic()
        html_extract.main_text(part * n)
        assert time.monotonic() - start < 30, part
    assert html_extract.main_text("<div>x" * 60_000) == " ".join("x" * 60_000)
