"""QC documents and refusals, sex accuracy and calibration digests, on constructed rows."""

import hashlib

import numpy as np
import pytest

from strideframe.operators import curate as C
from strideframe.operators import evaluation as E
from strideframe.operators import qc

TRACK = "track string, frame long"


def _inputs(spark, lengths):
    tracks = sorted({t for t, *_ in lengths})
    kps = spark.createDataFrame([(t, f, "a", 0, 0.9, 1.0, 1.0, 1.0) for t in tracks for f in range(4)], f"{TRACK}, kp string, pos int, conf double, x double, y double, z double")
    seg = spark.createDataFrame([(t, f, a, b, v) for t, a, b, v in lengths for f in range(4)], f"{TRACK}, a string, b string, length double")
    body = spark.createDataFrame([(t, f, 60.0, 1.0) for t in tracks for f in range(4)], f"{TRACK}, pitch double, height double")
    return kps, seg, body


def test_documents_leave_out_what_did_not_run(spark):
    kps, seg, body = _inputs(spark, [(t, a, b, v) for t in ("cams", "none") for a, b, v in (("h", "t", 1.0), ("l", "r", 2.0))])
    # frame 3 misfits: 50 px against a median of 1
    errors = spark.createDataFrame([("cams", f, c, v) for f, v in enumerate((1.0, 1.0, 1.0, 50.0)) for c in ("c0", "c1")], f"{TRACK}, camera string, err double")
    docs, refused = qc.qc_documents(kps, kps, seg, body, ["track"], "frame", fitted_errors=errors, measured_errors=errors, held_out=errors)
    got = {r.track: r for r in docs.collect()}
    assert refused.count() == 0 and all(r.structural_ok for r in got.values())
    assert got["cams"].blocks == ["reproj", "loo", "invariants", "coverage", "posture"] and got["none"].blocks == ["invariants", "coverage", "posture"]
    assert got["cams"].reproj.ratio == 1 and got["none"].reproj is None and got["none"].loo is None
    assert [(c.camera, c.median_px, c.n) for c in got["cams"].loo.cameras] == [("c0", 1.0, 4), ("c1", 1.0, 4)]
    assert (got["cams"].posture.n_pitched, got["cams"].posture.n_flagged, got["none"].posture.n_flagged) == (4, 1, 0)
    assert [(s.a, s.b, s.median) for s in got["none"].invariants.segments] == [("h", "t", 1.0), ("l", "r", 2.0)]


def test_refused_tracks_have_no_document(spark):
    bones = (("h", "t", 1.0), ("l", "r", 2.0), ("m", "n", 2.0))
    kps, seg, body = _inputs(spark, [("ok", *b) for b in bones] + [("flat", *b) for b in (*bones[1:], ("h", "t", 0.1))] + [("blank", *b) for b in bones])
    docs, refused = qc.qc_documents(kps, kps.where("track <> 'blank'"), seg, body, ["track"], "frame")
    assert [r.track for r in docs.collect()] == ["ok"]
    assert sorted(map(tuple, refused.collect())) == [("blank", "no_pose"), ("flat", "collapsed:h-t")]
    none, nothing = qc.qc_documents(*[d.limit(0) for d in (kps, kps, seg, body)], ["track"], "frame")
    assert none.count() == 0 and nothing.count() == 0


def test_sex_accuracy_judges_labelled_animals_with_a_slot(spark):
    flies = spark.createDataFrame(
        [(1, 0, 0, True, False), (1, 1, 1, True, False), (2, 0, -1, True, False), (2, 1, 0, False, False), (3, 0, 1, True, False)], "window int, fly int, sex int, valid boolean, prompt_on boolean"
    )
    logits = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (3, 2, None)], "window int, slot int, sex_logit double")
    hits = E.sex_hits(flies, E.assign_slots(flies), logits)
    assert sorted((r.window, r.fly, r.hit) for r in hits.collect()) == [(1, 0, True), (1, 1, False), (3, 0, False)]
    members = spark.createDataFrame([(1, "two"), (2, "blank"), (3, "one")], "window int, cohort string")
    got = {r.cohort: (r.sex_acc, r.n_judged) for r in E.sex_accuracy(hits, members).collect()}
    assert got == {"two": (0.5, 2), "blank": (None, 0), "one": (0.0, 1), "all": (pytest.approx(1 / 3), 3)}


def test_fingerprint_is_that_of_the_nested_list(spark):
    values = [1.0, -0.0, 0.5, 1e-6, 1.2e-5, -3e-5, 9.9e-5, 1e-4, 123456.789012, -2.0000005, 1e-9, 7.123456789]
    rigs = [("r", 1, "a", values), ("r", 0, "b", values[::-1]), ("s", 0, "b", [v + 1e-8 for v in values[::-1]]), ("s", 1, "a", values)]
    d = spark.createDataFrame(rigs, "recording string, position int, camera string, p array<double>")
    got = {r.recording: (r.fingerprint, r.cameras) for r in C.fingerprint(d, ["recording"]).collect()}

    def digest(*ps):
        return hashlib.sha256(repr(np.round(np.array(ps).reshape(-1, 3, 4), 6).tolist()).encode()).hexdigest()[:16]

    assert got["r"] == (digest(values[::-1], values), "b,a")
    assert got["s"][0] == digest([v + 1e-8 for v in values[::-1]], values)
    assert C.fingerprint(d.drop("position"), ["recording"]).where("recording = 'r'").first().fingerprint == digest(values, values[::-1])
