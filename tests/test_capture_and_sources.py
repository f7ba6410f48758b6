import json
import struct

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import headers
from gaugeline.operators import capture, forms, geometry, sweep, validation
from gaugeline.sources import corpus
from gaugeline.streaming import requests


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 12


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def test_jpeg_chain():
    fake = b"\xff\xe1" + struct.pack(">H", 1002) + jpeg(9, 9) + b"\0" * (1000 - len(jpeg(9, 9)))
    assert headers.jpeg_frame(jpeg(800, 640)) == (800, 640)
    assert headers.jpeg_frame(jpeg(800, 640, fake)) == (800, 640)
    assert headers.jpeg_frame(jpeg(800, 640, b"\xff\xff\xd0")) == (800, 640)
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\x00\x00", b"\xff\xd8\xff\xe0\x00\x01", jpeg(1, 1)[:8], None):
        assert headers.jpeg_frame(bad) is None


def test_requests_as_batch_and_stream(spark, tmp_path):
    rows = [
        ("ok", jpeg(800, 640), "image/jpeg", False, True, True, 100.0), ("mismatch", png(800, 640), "image/jpeg", False, True, True, 2000.0), ("gif", b"GIF89a" + b"\0" * 30, "", False, True, True, 1.0),
        ("small", png(100, 900), None, False, True, True, 1.0), ("large", png(60000, 60000), None, False, True, True, 1.0), ("body", jpeg(800, 640) + b"\0" * 12_000_000, None, False, True, True, 1.0),
        ("unverified", jpeg(800, 640), None, True, True, True, 1.0), ("retake", jpeg(800, 640), None, False, False, True, 1.0), ("blocked", jpeg(800, 640), None, False, True, False, 5000.0), ("null", None, None, False, True, True, None),
    ]
    df = spark.createDataFrame(rows, requests.SCHEMA)
    got = {r.id: r for r in requests.handled(df).collect()}
    assert {k: r.status_code for k, r in got.items()} == {"ok": 200, "mismatch": 200, "gif": 415, "small": 400, "large": 413, "body": 413, "unverified": 500, "retake": 200, "blocked": 503, "null": 415}
    assert {k: r.outcome for k, r in got.items() if r.status_code in (200, 503)} == {"ok": "analysis", "mismatch": "analysis", "retake": "retake_required", "blocked": "not_available"}
    assert got["mismatch"].content_type_mismatch and not got["ok"].content_type_mismatch and not got["small"].content_type_mismatch
    assert (got["mismatch"].within_p50, got["mismatch"].within_p95, got["blocked"].within_p95) == (False, True, False)
    df.write.parquet(str(tmp_path / "in"))
    requests.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {(r.id, r.status_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(k, r.status_code) for k, r in got.items()}


def test_failures_are_sorted_and_short_circuit(spark):
    cols = "n_faces int, face_h double, frame_h double, face_w double, yaw double, pitch double, roll double, lap double, ten double, luma double, clipped_low double, clipped_high double, specular double, shadow double, cast double, beard double, glasses double, frame_lap double, frame_ten double"
    good = [1, 500.0, 1000.0, 800.0, 0.0, 0.0, 0.0, 500.0, 500.0, 120.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 99.0, 99.0]
    bad = [2, 100.0, 1000.0, 800.0, 16.0, 0.0, 0.0, 5.0, 500.0, 250.0, 0.0, 0.5, 0.0, 0.2, 0.5, 0.4, 0.9, 1.0, 1.0]
    none = [0] + good[1:]
    df = spark.createDataFrame([tuple(x) for x in (good, bad, none)], cols).withColumn("visibility", F.create_map(F.lit("a"), F.lit(0.7), F.lit("b"), F.lit(0.1)))
    row = {c: F.col(c) for c in df.columns}
    got = [r[0] for r in df.select(capture.failures(row)).collect()]
    assert got == [[], ["blur", "color_cast", "extreme_pose", "face_too_small", "multiple_faces", "occlusion", "overexposed", "shadow_asymmetry"], ["no_face"]]
    assert [r[0] for r in df.select(capture.precheck(row)).collect()] == [[], ["blur", "color_cast"], []]
    appended = df.limit(1).select(capture.with_scale_floor(F.array(F.lit("zzz")), F.lit(80.0)).alias("a"), capture.with_scale_floor(F.array(F.lit("zzz")), F.lit(90.0)).alias("b")).first()
    assert appended.a == ["zzz", "face_too_small"] and appended.b == ["zzz"]
    with pytest.raises(ValueError):
        capture.check_limits({"min_face_px": 700, "canonical_px": 768})


def test_manifest_annotations_and_payload(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image,subject_id,device\na.jpg, s1 ,x\nb.jpg,s2,\na.jpg,s3,y\n")
    got = {r.image: (r.subject_id, r.device) for r in corpus.manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"a.jpg": ("s3", "y"), "b.jpg": ("s2", "")}
    with pytest.raises(ValueError):
        corpus.manifest(spark, str(tmp_path / "m.csv"), ("image", "consent"))
    (tmp_path / "l.csv").write_text("subject_id,concern,roi,severity\ns,c,r,mild\ns,c,r,unsure\n")
    with pytest.raises(ValueError):
        corpus.annotations(spark, str(tmp_path / "l.csv"))
    doc = {"concerns": {"redness": {"severity": "mild", "roi_results": [{"roi": "nose", "raw": {"x": 1.5}}, {"roi": "chin", "raw": {}}]}}}
    doc |= {"schema_version": "1", "qc": {"passed": False, "failures": ["blur"], "metrics": {"luma": 9.0}}}
    payloads = spark.createDataFrame([("i", json.dumps(doc)), ("j", "{"), ("k", None), ("l", json.dumps({"qc": {"passed": True}, "concerns": {"texture": {"severity": "unmeasurable"}}}))], "image string, payload string")
    got = sorted(map(tuple, corpus.records(payloads).collect()), key=str)
    none = (None,) * 5
    assert got == sorted([("i", "redness", "mild", "nose", "x", 1.5), ("i", "redness", "mild", "chin", None, None), ("j", *none), ("k", *none), ("l", "texture", "unmeasurable", None, None, None)], key=str)
    assert {(r.image, r.concern, tuple(r.rois)) for r in corpus.measured_regions(corpus.records(payloads)).collect()} == {("i", "redness", ("nose",)), ("l", "texture", ())}
    caps = {r.image: r for r in corpus.captured(payloads).collect()}
    assert (caps["i"].qc_passed, caps["i"].qc_failures, caps["i"].qc_metrics) == (False, ["blur"], {"luma": 9.0}) and caps["l"].qc_passed and caps["j"].qc_passed is None
    assert corpus.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 5}, "e": 6}) == {"a": {"b": 1, "c": 5}, "d": 3, "e": 6}
    assert corpus.profile({"default": {"x": 1}, "p": {"x": 2}}, "unknown") == {"x": 1}
    (tmp_path / "i").mkdir()
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / "i" / n).write_bytes(b"1234")
    assert sorted(r.image for r in corpus.images(spark, str(tmp_path / "i"), max_bytes=4).collect()) == ["a.png", "b.JPG"]


def test_reference_and_report_round_trip(spark, tmp_path):
    stats = spark.createDataFrame([("dark_spots", "nose", "m", 1.0, 2.0, 5, False)], "concern string, roi string, measurement string, median double, mad double, n_subjects long, calibrated boolean")
    corpus.write_reference(stats, str(tmp_path / "r"), {"schema_version": "1.0.0", "protocol_version": "1", "capture_profile": "default", "source_manifest_hash": "h"})
    r = corpus.read_reference(spark, str(tmp_path / "r")).first()
    assert (r.concern, r.median, r.schema_version, r.calibrated) == ("dark_spots", 1.0, "1.0.0", False)
    gates = spark.createDataFrame([("g", "pass", 1.0, 0.9)], "name string, status string, value double, bound double")
    corpus.write_report(gates, str(tmp_path / "g"), [])
    assert spark.read.json(str(tmp_path / "g")).first().release_evidence
    assert validation.release_ok(gates) and not validation.release_ok(gates.withColumn("status", F.lit("not_evaluated")))
    corpus.write_ragged_csv([spark.createDataFrame([("a", 1)], "image string, z int"), spark.createDataFrame([("b", 2)], "image string, c int")], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["image", "c", "z"]


def test_forms(spark):
    sub = spark.createDataFrame([("ab", "e1", "2024-01-02 03:04:05"), ("a", "e2", "2024-01-02 03:04:05"), ("x y", "e3", None), (None, "e4", None)], "subject_id string, email string, submitted_at string").withColumn("submitted_at", F.to_timestamp("submitted_at"))
    out = forms.accepted(sub).collect()
    assert [(r.subject_id, r.image) for r in out] == [("ab", "ab_20240102T030405Z.jpg")] and "email" not in out[0].asDict()
    assert forms.new_contacts(sub, spark.createDataFrame([("ab",)], "subject_id string")).count() == 0
    approved = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "subject_id string, position long")
    lab = spark.createDataFrame([("r", "s1"), ("r", "s3"), ("q", "zz"), ("d", "s1"), ("d", "s2"), ("d", "s3")], "rater_id string, subject_id string")
    assert forms.next_subject(approved, lab, "r").first().subject_id == "s2"
    every = {r.rater_id: r.subject_id for r in forms.next_subjects(approved, lab, lab.select("rater_id").distinct()).collect()}
    assert every == {"r": "s2", "q": "s1"}
    assert {r.rater_id: r.done for r in forms.progress(lab).collect()} == {"r": 2, "q": 1, "d": 3}
    grid = spark.createDataFrame([("c", "r1"), ("c", "r2")], "concern string, roi string")
    ans = spark.createDataFrame([("s", "c", "r1", "mild"), ("t", "c", "r1", "unsure"), ("t", "c", "r2", "high"), ("s", "c", "r2", "??")], "subject_id string, concern string, roi string, severity string")
    assert {r.subject_id: r.missing for r in forms.complete_grids(grid, ans, ["subject_id"]).collect()} == {"s": 1, "t": 0}
    lic = spark.createDataFrame([("a", "eligible", True, "1", "h", ["b"]), ("c", "eligible", False, "", "h", [])], "name string, decision string, commercial_allowed boolean, version string, hash string, requires array<string>")
    assert {tuple(r) for r in forms.licence_faults(lic).collect()} == {("a", "requires b"), ("c", "decision"), ("c", "version")}


def test_geometry(spark):
    pts = spark.createDataFrame([("g", float(x), float(y)) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (2, 0), (2, 2)]] + [("h", 0.0, 0.0), ("h", 1.0, 1.0)], "g string, x double, y double")
    edges = geometry.hull(pts, ["g"])
    inside = geometry.inside_hull(spark.createDataFrame([("g", 2.0, 2.0), ("g", 4.0, 1.0), ("g", 5.0, 1.0), ("h", 0.5, 0.5)], "g string, x double, y double"), edges, ["g"])
    assert {(r.g, r.x, r.y) for r in inside.collect()} == {("g", 2.0, 2.0), ("g", 4.0, 1.0)}
    a = spark.createDataFrame([("i", "left_cheek", 3.0), ("i", "right_cheek", 1.0), ("i", "left_eye", 1.0)], "image string, roi string, area double")
    assert [(r.roi, r.asymmetry) for r in geometry.paired(a, ["image"], "area").collect()] == [("cheek", 2.0)]
    assert not geometry.symmetric(a, [("left_cheek", "right_cheek")], 0.5).first().symmetry_ok
    runs = spark.createDataFrame([("i", k) for k in (1, 2, 3, 7, 9, 10)], "image string, x int")
    assert {(r.start, r.length) for r in geometry.runs(runs, ["image"], "x").collect()} == {(1, 3), (7, 1), (9, 2)}


def test_sweep(spark):
    rows = [("c", float(k), 10.0 + k, 1.0 / (k + 1)) for k in range(10)]
    s = sweep.sweep_thresholds(spark.createDataFrame(rows, "c string, laplacian_var double, tenengrad double, relative_drift double"), ["c"])
    got = {r.threshold: (r.n, r.min_tenengrad) for r in s.collect()}
    assert got == {float(k): (10 - k, 10.0 + k) for k in range(6)}
    assert sweep.recommended_floor(s, ["c"], 0.25).first().floor == 3.0
    assert sweep.recommended_floor(s, ["c"], None).first().floor is None


def test_hulls_of_all_lines(spark, tmp_path):
    import random

    from gaugeline.plans import registry

    r = random.Random(4)
    # suppliers of 1, 3, 5, ... lines, on both sides of order 400; the last one's lie on one line
    rows = [(350 + 7 * k, g, float(r.randrange(1, 30)), r.randrange(1, 8), r.randrange(0, 9) / 100) for g in range(12) for k in range(1 + 2 * g)] + [(900 + k, 99, float(k), k % 7 + 1, 0.0) for k in range(6)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_linenumber int, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = set()
    for g in {x[1] for x in rows}:
        pts = {(x[2], float(x[3])) for x in rows if x[1] == g}
        corners = {(x[2], float(x[3])) for x in rows if x[1] == g and x[4] <= 0.04}
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        # in a triangle of the corners, its sides included
        tri = [(a, b, c) for a in corners for b in corners for c in corners if turn(a, b, c) > 0]
        want |= {(g, *p) for p in pts if any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for a, b, c in tri)}
    got = [(x.g, x.x, x.y) for x in registry.queries()["hull_membership"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_the_queue_offers_all_customers(spark, tmp_path):
    from gaugeline.plans import registry

    keys = sorted([*range(3, 120, 2), *range(65530, 65545), 200_000])  # more than 40, with gaps, in three ranges of keys
    n = len(keys)
    events = [(k, 1) for k in range(60)] + [(k, 2) for k in range(1, 50)] + [(k, 3) for k in range(2 * n)] + [(n, 4), (n + 1, 4), (2, 4), (0, 5), (2, 5)]
    spark.createDataFrame([(k,) for k in reversed(keys)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    done = {}
    for e, u in events:
        done.setdefault(u, set()).add(keys[e % n])
    first = {u: min(set(keys) - v) for u, v in done.items() if set(keys) - v}
    got = registry.queries()["label_queue"](spark, str(tmp_path)).collect()
    assert sorted((x.rater_id, x.subject_id) for x in got) == sorted(first.items()) and set(first) == {1, 2, 4, 5} and first[1] > 40
    got = registry.queries()["rater_progress"](spark, str(tmp_path)).collect()
    assert {x.rater_id: x.done for x in got} == {u: len(v) for u, v in done.items()} and len(done[3]) > 40
