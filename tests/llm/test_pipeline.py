import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gaugeline.llm import q_tokens, secret_scan  # noqa: E402
from tests.llm.test_neardup import brute  # noqa: E402
from tests.llm.test_topk_and_mixing import simulate  # noqa: E402


def test_stages_against_brute_force(spark, docs_schema, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(9)
    vocab = [f"word{k}" for k in range(500)]
    text = lambda: " ".join(r.choice(vocab) for _ in range(60)).capitalize() + "."
    good = [text() for _ in range(90)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(good)]
    rows += [(100 + k, good[k] + (" more" if k % 2 else ""), "en", "src1", 0) for k in range(20)]
    rows += [(200 + k, "*** ".join(r.choice(vocab) for _ in range(60)) + " $$$", "en", "src2", 0) for k in range(30)]
    rows += [(300, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + text(), None, None, None), (None, text(), "en", "src0", 1), (301, None, "en", "src0", 0), (302, "", "en", "src0", 0)]
    spark.createDataFrame(rows, docs_schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(200 + k, 0, 0) for k in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = [x for x in rows if x[1] and "***" not in x[1]]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
            seen.append(sorted((tuple(x) for x in docs.collect()), key=str))
        else:
            last = out.collect()
    assert [x[:2] for x in seen[0]] == sorted((x[:2] for x in kept), key=str)
    roots = brute([x[:2] for x in kept])
    alone = [x for x in kept if x[0] is None or roots[x[0]] == x[0]]
    assert [x[:2] for x in seen[1]] == sorted((x[:2] for x in alone), key=str)
    auto = secret_scan.automaton()
    assert len(seen[2]) == len(alone) and not any(secret_scan.scan(x[1], auto) for x in seen[2])
    assert seen[3] == seen[2]
    order = [x.doc_id for x in sorted(last, key=lambda x: (x.mix_part, x.mix_row))]
    want = sorted(simulate([(x[0], x[3]) for x in alone], corpus_pipeline.q_mixing.WEIGHTS, corpus_pipeline.q_mixing.OTHER, corpus_pipeline.mixing.BLOCK), key=lambda x: (x[2], x[3]))
    assert order == [x[0] for x in want]
    lib, texts = Tokenizer.from_file(q_tokens.PATH), {x[0]: x[1] for x in seen[3]}
    assert all(list(x.ids) == lib.encode(texts[x.doc_id], add_special_tokens=False).ids and x.n_tokens == len(x.ids) for x in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_clashing_columns_and_empty_tables(spark, docs_schema, tmp_path):
    """Columns named like the operators' own hold what they held after every stage."""
    names = ["slot", "Place", "pool", "block", "spans", "gumbel", "drawn", "log_weight", "n_grams", "__row", "kept", "component_id", "mix_part", "ids", "n"]
    words = [f"word{k}" for k in range(200)]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" token = 24be64439e3e49cf46b2" if i == 2 else ""), "en", f"src{i % 3}", 1) for i in range(12)] + [(3, None, None, None, None), (3, "another text here", None, None, None), (None, "no id at all", "en", "src1", 3)]
    extra = [tuple(100 * k + i for k in range(len(names))) for i in range(len(rows))]
    df = spark.createDataFrame([a + b for a, b in zip(rows, extra, strict=True)], docs_schema + "".join(f", {c} long" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    of = {(a[0], b[0]): b for a, b in zip(rows, extra, strict=True)}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / f"s{k}"))
        df = spark.read.parquet(str(tmp_path / f"s{k}"))
        got = df.collect()
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert len(got) >= 13 and all(tuple(x)[5:] == of[x.doc_id, x.slot] for x in got)
    last = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert len(last) == 14 - 1 and all(x.mix_part < 1000 for x in last)
    empty = spark.createDataFrame([], docs_schema)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0
