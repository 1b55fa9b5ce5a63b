"""Readers and writers on small files."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions.names import order_digest
from strideframe.sources import landmark_csv as LC
from strideframe.sources import sinks
from strideframe.sources import tables as ST


def wide_csv(path, names, n, *, coords=("x", "y", "z", "confidence")):
    head = ",".join(k for k in names for _ in range(4)) + "\n" + ",".join(c for _ in names for c in coords) + "\n"
    body = "".join(",".join(str(v) for k in range(len(names)) for v in (f + k / 10, f, -f, 0.9)) + "\n" for f in range(n))
    path.write_text(head + body)


def test_kp3d_rows_are_frames_across_splits(spark, tmp_path):
    wide_csv(tmp_path / "recA.csv", ["EyeL", "EyeR"], 500)
    wide_csv(tmp_path / "recB.csv", ["EyeR", "EyeL"], 3)
    wide_csv(tmp_path / "bad.csv", ["EyeL"], 3, coords=("y", "x", "z", "confidence"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        kps, bad = LC.read_kp3d(spark, str(tmp_path / "*.csv"))
        assert kps.where((F.col("y") != F.col("frame")) | (F.abs(F.col("x") - F.col("frame") - F.col("pos") / 10) > 1e-9)).count() == 0
        assert kps.where("recording = 'recA'").count() == 1000 and kps.where("recording = 'recB' AND kp = 'EyeR' AND pos = 0").count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in bad.collect()] == [("bad", "coordinate_order")]
    bouts = spark.createDataFrame([("recA", 1, 10, 12), ("recB", 2, 1, 4)], "recording string, bout int, start_frame long, end_frame long")
    got, short = LC.bout_landmarks(kps, bouts, width=4)
    assert got.where("bout = 1").count() == 6
    assert [tuple(r) for r in short.collect()] == [("recB", 2, 4, 2)]


def test_kp2d_marks_unassigned_points(spark, tmp_path):
    (tmp_path / "r.csv").write_text("skeleton.json\n5,0,1.5,2.5,1,2000000,3\n6,1,4,5,7,1,1\n\n")
    got = sorted(map(tuple, LC.read_kp2d(spark, str(tmp_path / "r.csv")).collect()))
    assert got == [("r", 5, 0, 1.5, 2.5), ("r", 5, 1, None, None), ("r", 6, 1, 4.0, 5.0)]


def test_bout_tables(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Fly_ID,Bout,Start_Frame,End_Frame,N_frames\nS1/rec_1,1,10,19,10\nS1/rec_1,2,30,39,9\nS2/rec,3,1,2,2\n")
    bouts, bad = ST.read_bout_summary(spark, str(tmp_path / "b.csv"), session_tag="rec")
    assert sorted(r.idx for r in bouts.collect()) == [1, 2, 3]
    assert [tuple(r) for r in bad.collect()] == [(2, 9, 10)]
    one, _ = ST.read_bout_summary(spark, str(tmp_path / "b.csv"), session_tag="S2")
    assert [r.idx for r in one.collect()] == [3]
    ST.write_bouts(bouts, str(tmp_path / "out"))
    assert sorted(map(tuple, ST.read_bouts(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, bouts.collect()))
    (tmp_path / "c.csv").write_text("start_frame,end_frame\n1,2\n")
    with pytest.raises(ValueError, match="no bout column"):
        ST.read_bout_summary(spark, str(tmp_path / "c.csv"))


def test_cohort_index_reads_the_named_column(spark, tmp_path):
    (tmp_path / "i.csv").write_text(",flyID,sex\nrec1,M,female\nrec2,F,m\nrec3,F,?\n")
    recs = spark.createDataFrame([("rec1",), ("rec2",), ("rec3",), ("rec9",)], "recording string")
    got = {r.recording: r.sex for r in ST.cohort_sex(spark, str(tmp_path / "i.csv"), recs).collect()}
    assert got == {"rec1": "female", "rec2": "male", "rec3": "unknown", "rec9": "unknown"}


def test_calibrations(spark, tmp_path):
    g = tmp_path / "A"
    g.mkdir()
    (g / "Cam1.yaml").write_text("%YAML:1.0\nprojectionMatrix: !!opencv-matrix\n   rows: 3\n   cols: 4\n   data: [ 1., 2.5, -3e-1,\n 4, 5, 6, 7, 8, 0, 0, 0, 1 ]\n")
    (g / "Cam2.yaml").write_text("projectionMatrix:\n  data: [1, 2]\n")
    ok, bad = ST.read_calibrations(spark, str(g / "*.yaml"))
    r = ok.first()
    assert (r.calib_group, r.camera, r.p[:3], r.p[-1]) == ("A", "Cam1", [1.0, 2.5, -0.3], 1.0)
    assert [x.camera for x in bad.collect()] == ["Cam2"]
    (tmp_path / "Cam7_dlt.csv").write_text("\n".join(str(i / 2) for i in range(11)))
    ok, bad = ST.read_dlt(spark, str(tmp_path / "*_dlt.csv"))
    assert ok.first().camera == "Cam7" and len(ok.first().c) == 11 and bad.count() == 0


def test_labelled_root(spark, tmp_path):
    (tmp_path / "annotations").mkdir()
    coco = {
        "keypoint_names": ["a", "b"],
        "images": [{"id": 1, "file_name": "r/c/Frame_1.jpg", "recording": "r", "width": 64, "height": 48}],
        "annotations": [{"id": 5, "image_id": 1, "keypoints": [1, 2, 2, 3, 4, 2], "fly_id": 0, "sex": "female"}],
        "framesets": {"r/Frame_1/fly0": {"recording": "r", "fly_id": 0, "frames": [1], "ann_ids": [None], "partners": {"1": 2}}},
    }
    (tmp_path / "annotations" / "instances_train.json").write_text(json.dumps(coco))
    (tmp_path / "manifest.json").write_text(json.dumps({"version": "v", "sources": {"s": {"kind": "human"}, "t": {"kind": "odd"}}, "recordings": {"r": {"calib_group": "A", "fly_sex": {"fly0": "male"}}}}))
    t = ST.read_instances(spark, str(tmp_path), "train")
    fs = t["framesets"].first()
    assert (fs.key, fs.frames, fs.ann_ids, fs.partners) == ("r/Frame_1/fly0", [1], [None], {"1": 2})
    assert t["annotations"].first().keypoints[3] == 3.0 and t["keypoints"].count() == 2 and t["images"].first().id == 1
    m = ST.read_manifest(spark, str(tmp_path))
    assert [(r.source_id, r.weight) for r in m["sources"].collect()] == [("s", 1.0)]
    assert [r.source_id for r in m["invalid"].collect()] == ["t"] and m["recordings"].first().fly_sex == {"fly0": "male"}


def test_masks_and_artifacts(spark, tmp_path):
    root = tmp_path / "masks"
    for rec, cam, n, ids in (("r", "c", 3, [4, 9]), ("q", "c", 1, [2])):
        p = root / rec / cam
        p.mkdir(parents=True)
        np.savez_compressed(p / f"Frame_{n}.npz", ann_ids=np.array(ids), masks=np.ones((len(ids), 2, 3), bool))
    (root / "Frame_7.npz").write_bytes((root / "r" / "c" / "Frame_3.npz").read_bytes())
    files, bad = ST.mask_files(spark, str(root))
    assert sorted((r.recording, r.camera, r.frame) for r in files.collect()) == [("q", "c", 1), ("r", "c", 3)] and bad.count() == 1
    ix = ST.mask_index(files, 4).first()
    assert (ix.n_files, ix.recordings, ix.coverage) == (2, ["q", "r"], 0.5)
    rows = ST.read_mask_rows(spark, str(root / "r"))
    assert sorted(r.ann_id for r in rows.collect()) == [4, 9] and rows.first().height == 2
    names = ["a", "b"]
    sha = spark.range(1).select(order_digest(F.array(*[F.lit(n) for n in names])).alias("s")).first().s
    buf = io.BytesIO()
    np.savez(buf, kp3d=np.arange(12.0).reshape(2, 2, 3), conf3d=np.full((2, 2), 0.5), kp_names=np.array(names), order_sha=np.array(sha))
    (tmp_path / "bout.npz").write_bytes(buf.getvalue())
    np.savez(tmp_path / "plain.npz", kp3d=np.zeros((1, 1, 3)))
    d = ST.read_artifacts(spark, str(tmp_path / "*.npz"))
    got = d.where("kp = 'b' AND frame = 1").first()
    assert (got.x, got.z, got.conf, got.order_sha) == (9.0, 11.0, 0.5, sha)
    assert d.where(F.col("kp").isNull()).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0), ("b", 0, 5.0)], "clip string, frame int, v double")
    clips = sinks.clip_arrays(rows, ["clip"], "frame", ["v"]).withColumn("assay", F.lit("x"))
    pad = {r.clip: (r.clip_length, r.v) for r in sinks.padded_clips(clips, ["v"]).collect()}
    assert pad == {"a": (2, [1.0, 2.0]), "b": (1, [5.0, 0.0])}
    sinks.write_combined(clips, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("assay = 'x'").count() == 2
    with pytest.raises(ValueError, match="no clips"):
        sinks.write_combined(clips.limit(0), str(tmp_path / "d"))
    rng = sinks.clip_ranges(clips.select(F.concat(F.lit("S/"), "clip").alias("rec")), "rec")
    assert [tuple(r) for r in rng.orderBy("rec").select("rec", "clip_start", "clip_stop", "session").collect()] == [("S/a", 0, 1, "S"), ("S/b", 1, 2, "S")]
    assert sinks.range_findings(rng, clips).count() == 0 and sinks.range_findings(rng, clips.limit(1)).count() == 1
    sinks.write_scorecard(spark.createDataFrame([("b1", 0, "ok")], "bout string, fly int, status string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().status == "ok"
    sinks.write_checksums(spark.createDataFrame([("b", "2"), ("a", "1")], "name string, sha256 string"), str(tmp_path / "k"))
    assert [r.value for r in spark.read.text(str(tmp_path / "k")).collect()] == ["1  a", "2  b"]


def test_recording_findings(spark):
    d = spark.createDataFrame([("a", 800.0, True), ("b", None, False), ("c", 0.0, None)], "name string, fps double, has_rig boolean")
    assert sorted(map(tuple, ST.recording_findings(d).collect())) == [("b", "fps_required"), ("c", "calib_dir_undeclared"), ("c", "fps_required")]


def test_cohort_sex_is_that_of_the_first_row(spark, tmp_path):
    from strideframe.sources.tables import cohort_sex

    p = tmp_path / "index.csv"
    p.write_text("name,sex\nrec1,\nrec1,m\nrec2,f\nrec2,m\n")
    got = cohort_sex(spark, str(p), spark.createDataFrame([("rec1",), ("rec2",), ("rec3",)], "recording string"))
    assert {r.recording: r.sex for r in got.collect()} == {"rec1": "unknown", "rec2": "female", "rec3": "unknown"}


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, n in (("s1", 3), ("s2", 4)):
        (tmp_path / folder).mkdir()
        wide_csv(tmp_path / folder / "data3D.csv", ["EyeL"], n)
        (tmp_path / folder / "p.csv").write_text(f"skeleton.json\n0,0,{n},2\n")
    path = str(tmp_path / "*" / "data3D.csv")
    kps, bad = LC.read_kp3d(spark, path)
    assert kps.count() == 0 and [tuple(r) for r in bad.collect()] == [("data3D", "recording_in_two_files")]
    kps, bad = LC.read_kp3d(spark, path, LC.folder_of())
    assert {r.recording: r["count"] for r in kps.groupBy("recording").count().collect()} == {"s1": 3, "s2": 4} and bad.count() == 0
    twos = LC.read_kp2d(spark, str(tmp_path / "*" / "p.csv")).collect()
    assert sorted((r.recording.split("/")[-2], r.u) for r in twos) == [("s1", 3.0), ("s2", 4.0)]
