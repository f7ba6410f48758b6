import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import robust, vocab
from gaugeline.operators import cohort, policy, results, validation


def test_band_edges(spark):
    z = [-5.0, 0.0, 0.49, 0.5, 1.49, 1.5, 2.49, 2.5, 99.0, None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(z)], "k int, z double").select("k", vocab.to_band(F.col("z")).alias("b"), vocab.rank(vocab.to_band(F.col("z"))).alias("r")).orderBy("k").collect()
    assert [r.b for r in rows] == ["not_detected"] * 3 + ["mild"] * 2 + ["moderate"] * 2 + ["high"] * 2 + [None]
    assert [r.r for r in rows] == [0, 0, 0, 1, 1, 2, 2, 3, 3, -1]
    with pytest.raises(ValueError):
        vocab.to_band(F.col("z"), (1.0, 1.0, 2.0))


def test_support_policy(spark):
    rows = [
        ("two", "a", "high", False), ("two", "b", "high", False),
        ("lone", "a", "high", False), ("lone", "b", "not_detected", False),
        ("strong", "a", "high", True), ("strong", "b", "mild", False),
        ("elsewhere", "a", "high", False), ("elsewhere", "b", "mild", True),
        ("mild", "a", "mild", False), ("none", "a", "not_detected", False), ("blank", "a", "unmeasurable", False),
    ]
    out = policy.aggregated(spark.createDataFrame(rows, "image string, roi string, severity string, strong boolean").withColumn("concern", F.lit("redness")), ["image"])
    got = {r.image: (r.severity, r.regions, r.demoted) for r in out.collect()}
    assert got == {
        "two": ("high", ["a", "b"], False), "lone": ("moderate", ["a"], True), "strong": ("high", ["a", "b"], False), "elsewhere": ("moderate", ["a", "b"], True),
        "mild": ("not_detected", ["a"], True), "none": ("not_detected", [], False), "blank": ("unmeasurable", [], False),
    }


def test_null_floor_blocks_and_all_floors_count(spark):
    df = spark.createDataFrame([("a", {"x": 5.0, "y": 1.0}), ("b", {"x": 5.0}), ("c", {"x": 9.0})], "concern string, raw map<string,double>")
    got = {r.concern: r.s for r in df.select("concern", policy.strong(F.col("raw"), {"a": {"x": 5.0, "y": 1.0}, "b": {"x": 5.0, "y": 1.0}, "c": {"x": None}}, F.col("concern")).alias("s")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_combine_needs_every_direction_and_reference(spark):
    z = spark.createDataFrame([(1, "t", "r", "m", 2.0), (1, "t", "r", "n", -1.0), (1, "u", "r", "m", 2.0), (1, "u", "r", "q", 1.0), (2, "t", "r", "m", None)], "image int, concern string, roi string, measurement string, z_ref double")
    d = spark.createDataFrame([("t", "m", 1.0), ("t", "n", -1.0), ("u", "m", 1.0)], "concern string, measurement string, direction double")
    got = {(r.image, r.concern): r.z for r in policy.combined(z, ["image"], d, {"t": "median", "u": "max"}).collect()}
    assert got == {(1, "t"): 1.5, (1, "u"): None, (2, "t"): None}
    assert [(r.image, r.concern) for r in policy.undecidable(z, ["image"]).collect()] == [(2, "t")]
    with pytest.raises(ValueError):
        policy.combined(z, ["image"], d, {"t": "mode"})


def test_publication_refusals_in_order(spark):
    base = {"calibrated": True, "protocol_version": "1", "source": "s", "manifest": True, "frozen": True, "n_subjects": 200, "missing": []}
    cases = [({}, None), ({"calibrated": False, "frozen": False}, "not calibrated"), ({"protocol_version": "2"}, "protocol mismatch"), ({"source": " "}, "no source named"), ({"manifest": None}, "no manifest"), ({"frozen": False}, "not frozen"), ({"n_subjects": 199}, "cohort too small"), ({"missing": ["chin"]}, "regions without statistics: chin")]
    schema = "k int, h struct<calibrated: boolean, protocol_version: string, source: string, manifest: boolean, frozen: boolean, n_subjects: int, missing: array<string>>"
    df = spark.createDataFrame([(k, {**base, **c}) for k, (c, _) in enumerate(cases)], schema)
    assert [r.r for r in df.orderBy("k").select(policy.publication_refusal(F.col("h"), "1").alias("r")).collect()] == [w for _, w in cases]


def test_public_view_has_no_number(spark):
    df = spark.createDataFrame([("i", "c", "mild", ["a"], 1, 2.0)], "image string, concern string, severity string, regions array<string>, n_at_max int, z double")
    assert not [t for _, t in policy.public(df, ["image"]).dtypes if any(x in t for x in ("int", "double", "float", "decimal"))]


def test_split_is_salted_and_stable(spark):
    ids = [f"s{k}" for k in range(2000)]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", cohort.split(F.col("s"), "x").alias("a"), cohort.split(F.col("s"), "y").alias("b")).collect()}
    want = {i: "holdout" if int(hashlib.sha256(f"x:{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.3 else "train" for i in ids}
    assert {i: a for i, (a, _) in got.items()} == want
    assert abs(sum(a == "holdout" for a, _ in got.values()) / 2000 - 0.3) < 0.05 and any(a != b for a, b in got.values())


def brute_fit(rows):
    rows = sorted(rows)
    lab, n = [vocab.BANDS.index(b) for _, b in rows], len(rows)
    best = None
    for i, j, k in itertools.combinations_with_replacement(range(n + 1), 3):
        cost = sum(b != (0 if p < i else 1 if p < j else 2 if p < k else 3) for p, b in enumerate(lab))
        if best is None or cost < best[0]:
            best = (cost,)
    return best[0]


def test_fit_equals_every_cut(spark):
    r = random.Random(7)
    groups = {g: [(round(r.uniform(0, 40), 3), r.choice(vocab.BANDS)) for _ in range(14)] for g in range(6)}
    groups[6] = [(float(k), vocab.BANDS[k // 5]) for k in range(20)]
    groups[7] = [(1.0, "mild")]
    df = spark.createDataFrame([(g, z, b) for g, v in groups.items() for z, b in v], "g int, z double, label string")
    got = {x.g: x for x in cohort.fitted_cuts(df, ["g"]).collect()}
    assert {g: x.misclassified for g, x in got.items()} == {g: brute_fit(v) for g, v in groups.items()}
    assert (got[6].t0, got[6].t1, got[6].t2, got[6].fitted) == (4.5, 9.5, 14.5, True) and not got[7].fitted


def test_agreement_and_empty_evaluation(spark):
    cap = spark.createDataFrame([(1, "s1", "a"), (2, "s1", "a"), (3, "s2", ""), (4, "s2", None), (5, "s3", "a"), (6, " ", "a"), (7, " ", "a"), (8, "s4", "a"), (9, "s4", "a")], "image int, subject_id string, session_id string")
    sev = spark.createDataFrame([(1, "c", "mild"), (2, "c", "mild"), (3, "c", "mild"), (4, "c", "high"), (8, "c", "mild"), (9, "c", "unmeasurable")], "image int, concern string, severity string")
    g = validation.groups(cap)
    assert {(r.subject_id, r.session) for r in g.collect()} == {("s1", "a"), ("s2", "_"), ("s4", "a")}
    assert [tuple(r) for r in validation.ordinal_agreement(g, sev).collect()] == [("c", 1, 2)]
    empty = spark.createDataFrame([], "predicted string, label string")
    r = cohort.evaluated(empty, []).first()
    assert (r.n, r.exact, r.adjacent) == (0, None, None)


def test_variation_counts_only_common_measurements(spark):
    g = validation.groups(spark.createDataFrame([(1, "s", ""), (2, "s", "")], "image int, subject_id string, session_id string"))
    f = spark.createDataFrame([(1, "c", "r", "m", 1.0), (2, "c", "r", "m", 3.0), (1, "c", "r", "n", 5.0), (1, "c", "q", "z", -1.0), (2, "c", "q", "z", 1.0)], "image int, concern string, roi string, measurement string, value double")
    got = {r.measurement: r.cv for r in validation.metric_cvs(g, f).collect()}
    assert got["z"] is None and abs(got["m"] - 2**0.5 / 2) < 1e-12 and "n" not in got
    a = {r.concern: (r.agreed, r.examined) for r in validation.roi_availability(g, f, ["c", "d"]).collect()}
    assert a == {"c": (1, 1)}


def test_majority_prefers_the_first_of_equals(spark):
    v = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "a", 3), ("s", "b", 4), ("t", "c", 5)], "s string, label string, at int")
    assert {(r.s, r.label, r.n, r.n_labels) for r in cohort.majority(v, ["s"], "label", ["at"]).collect()} == {("s", "b", 2, 2), ("t", "c", 1, 1)}


def test_robust_statistics(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 9)] + [("b", 5.0), ("b", None), ("c", 100.0)] + [("d", float(k)) for k in range(20)], "g string, v double")
    m = {r.g: (r["median"], r.mad) for r in robust.medians_and_mads(df, ["g"], "v").collect()}
    assert m["a"] == (3.0, 1.5) and m["b"] == (5.0, 0.0)
    t = {r.g: r.robust_mean for r in robust.robust_mean(df, ["g"], "v").collect()}
    assert t["c"] == 100.0 and t["d"] == sum(range(2, 18)) / 16
    px = spark.createDataFrame([(2.5, 3.5, 62.5)], "a double, b double, c double")
    assert tuple(px.select(robust.to_pixels(1.0, F.col("a")), robust.to_pixels(1.0, F.col("b"), odd=True), robust.to_pixels(0.001, F.col("c"))).first()) == (2, 5, 1)
    assert df.groupBy("g").agg(robust.fraction(F.col("v") > 3).alias("f")).where("g = 'a'").first().f == 0.5


def test_selection_is_exact_beyond_a_bracket(spark):
    """Groups larger than a bracket, of spread values, of ties and of one value, beside small ones and a null key, over several partitions."""
    big = 3 * robust.WHOLE
    rows = {
        "spread": [((k * 7919) % 100_003) / 7 - 5000 for k in range(big)],
        "ties": [float(k % 3) for k in range(big + 1)],
        "mostly_one": [1.5] * big + [float(k) for k in range(100)],
        "skewed": [float(k % 1000) ** 4 for k in range(big + 2)],
        "small": [3.0, 1.0, 2.0, 10.0],
        None: [4.0, 8.0],
    }
    flat = pd.DataFrame([(g, v) for g, vs in rows.items() for v in vs], columns=["g", "v"]).sample(frac=1, random_state=5)
    df = spark.createDataFrame(flat, "g string, v double").union(spark.createDataFrame([("none", None)], "g string, v double")).repartition(9)
    qs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    got = {r.g: r for r in robust.quantiles(df, ["g"], "v", qs).collect()}
    assert set(got) == set(rows)
    mads = {r.g: (r["median"], r.mad) for r in robust.medians_and_mads(df, ["g"], "v").collect()}
    means = {r.g: (r.n, r.robust_mean) for r in robust.robust_mean(df, ["g"], "v").collect()}
    for g, vs in rows.items():
        assert got[g].n == len(vs)
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12)
        mid = np.median(vs)
        assert mads[g] == pytest.approx((mid, np.median(np.abs(np.array(vs) - mid))), rel=1e-12)
        cut = int(len(vs) * 0.1) if len(vs) > 2 else 0
        assert means[g] == pytest.approx((len(vs), np.mean(sorted(vs)[cut : len(vs) - cut])), rel=1e-9)
    assert robust.quantiles(df.where("false"), ["g"], "v", {"m": 0.5}).count() == 0
    ends = robust.unit_scale(df.where("g = 'small' or g = 'none' or g is null"), ["g"], "v").collect()
    assert {(r.g, r.v): round(r.unit, 6) for r in ends}[("small", 10.0)] == 1.0 and len(ends) == 7


def test_slices_drop_blanks_and_spread_needs_two(spark):
    df = spark.createDataFrame([("x", " ", 1.0)] * 5 + [("y", None, 0.0)] * 5 + [("z", "q", 0.0)], "a string, b string, v double")
    s = cohort.sliced(df, ["a", "b"], ["v"]).groupBy("column", "value").agg(F.avg("v").alias("r"), F.count("*").alias("n")).withColumn("gated", F.col("n") >= 5)
    assert {(r["column"], r["value"], r.n) for r in s.collect()} == {("a", "x", 5), ("a", "y", 5), ("a", "z", 1), ("b", "q", 1)}
    assert {r["column"]: r.spread for r in cohort.spread(s, "r").collect()} == {"a": 1.0, "b": None}


def test_region_cuts_of_all_subjects(spark):
    import os

    import numpy as np

    from gaugeline.plans import q_cohort

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no data")
    groups = {}
    for x in q_cohort._samples(spark, data).collect():
        groups.setdefault((x.concern, x.roi), []).append((x.z, x.label, x.subject_id))
    assert max(x[2] for v in groups.values() for x in v) > 60
    got = {(x.concern, x.roi): (x.n, x.misclassified) for x in q_cohort.threshold_fit(spark, data).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        lab = np.array([vocab.BANDS.index(x[1]) for x in sorted(v)])
        c = [np.concatenate([[0], np.cumsum(lab == b)]) for b in range(4)]
        i, j, k = np.ix_(*[range(len(lab) + 1)] * 3)
        right = np.where((i <= j) & (j <= k), c[0][i] + (c[1][j] - c[1][i]) + (c[2][k] - c[2][j]) + (c[3][-1] - c[3][k]), -1)
        assert got[g] == (len(lab), len(lab) - right.max()), g


def test_results_are_published_whole_or_not(spark):
    rows = spark.createDataFrame([(1, "analysis", "redness", "mild", ["nose"], ["chin"], None)], "image int, status string, concern string, severity string, regions array<string>, unmeasurable_regions array<string>, note string")
    kind = "concern string, header struct<calibrated: boolean, protocol_version: string, source: string, manifest: boolean, frozen: boolean, n_subjects: int, missing: array<string>>"
    good, small = (True, "p1", "clinic", True, True, 300, []), (True, "p1", "clinic", True, True, 3, [])
    out = results.published(rows, spark.createDataFrame([("redness", good)], kind), "p1")
    assert out.columns == ["image", "status", "concern", "severity", "regions"] and out.first().regions == ["nose"]
    with pytest.raises(ValueError, match="texture: cohort too small"):
        results.published(rows, spark.createDataFrame([("redness", good), ("texture", small)], kind), "p1")


def test_results_of_no_captures(spark):
    c = spark.createDataFrame([], "image int, qc_passed boolean")
    m = spark.createDataFrame([], "image int, concern string, roi string, measurement string, value double")
    r = spark.createDataFrame([], "image int, concern string, reason string")
    ref = spark.createDataFrame([], "concern string, roi string, measurement string, median double, mad double")
    d = spark.createDataFrame([], "concern string, measurement string, direction double")
    p = spark.createDataFrame([("redness", "nose")], "concern string, roi string")
    assert results.analysed(c, m, r, ref, d, {"redness": "max"}, {}, p).count() == 0
    c = spark.createDataFrame([(1, None), (2, True), (3, True)], "image int, qc_passed boolean")
    m = spark.createDataFrame([(2, "redness", "nose", None, None), (1, "redness", "nose", "x", 1.0), (2, None, "nose", "visible", 0.5)], m.schema)
    got = {(x.image, x.status, x.concern, x.severity, tuple(x.unmeasurable_regions)) for x in results.analysed(c, m, r, ref, d, {"redness": "max"}, {}, p).collect()}
    assert got == {(1, "retake_required", None, None, ()), (2, "analysis", "redness", "unmeasurable", ("nose",))}
