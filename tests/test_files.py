"""Calibration and label files, and track association."""

import numpy as np
import pytest

from pitchflow.sources import files
from pitchflow.streaming.association import associate


def test_calibration_files(spark, tmp_path):
    rows = [("v", 0, f"p{i}", float(i), 2.0, i / 10, 0.5) for i in range(4)]
    pairs = spark.createDataFrame(rows, "video string, frame bigint, name string, pixel_x double, pixel_y double, pitch_x double, pitch_y double")
    files.write_correspondences(pairs, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_correspondences(spark, str(tmp_path / "c")).collect())) == rows
    with pytest.raises(ValueError):
        files.write_correspondences(pairs.limit(3), str(tmp_path / "d"))
    h = np.arange(9.0).reshape(3, 3)
    files.save_homography(spark, h, str(tmp_path / "h"))
    assert (files.load_homography(spark, str(tmp_path / "h")) == h).all()


def test_label_files(spark, tmp_path):
    (tmp_path / "train" / "labels").mkdir(parents=True)
    (tmp_path / "train" / "labels" / "a.txt").write_text("0 1 2 3 4\n\n1 1 1 1 1\n")
    got = files.read_labels(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("train", "a", "0 1 2 3 4"), ("train", "a", "1 1 1 1 1")]
    assert "labels/split=train" in files.write_labels(got, str(tmp_path / "out"), ["ball"])
    assert spark.read.text(str(tmp_path / "out/labels")).count() == 2


def test_options_and_binary_files(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("# run\nmax_coast_frames: 7  # frames\n\nother: x\nperson_confidence : 0.25\n")
    assert files.read_options(spark, str(tmp_path / "o.yaml")) == files.Options(max_coast_frames=7, person_confidence=0.25)
    for name, data in (("frame_012.jpg", b"ab"), ("anchor.png", b"c"), ("empty7.png", b""), ("note.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.number, r.length, bytes(r.content)) for r in files.read_binary(spark, str(tmp_path), "*.{jpg,png}").collect()}
    assert got == {"frame_012.jpg": (12, 2, b"ab"), "anchor.png": (None, 1, b"c")}


def test_association(spark):
    rows = [("c", f, f * 10 + k, x + f, 0.0, x + f + 10, 10.0, c) for f in (0, 1, 2, 5, 60) for k, (x, c) in enumerate(((0.0, 0.9), (100.0, 0.9 if f != 2 else 0.1), (300.0, 0.1)))]
    boxes = spark.createDataFrame(rows, "clip_id string, frame bigint, det_seq bigint, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {(r.frame, r.det_seq % 10): r.track_id for r in associate(boxes).collect()}
    assert [got[f, 0] for f in (0, 1, 2, 5, 60)] == [1, 1, 1, 1, 3] and [got[f, 1] for f in (0, 1, 2, 5, 60)] == [2, 2, 2, 2, 4]
    assert all(got[f, 2] == -1 for f in (0, 1, 2, 5, 60))


def test_options_in_sections(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# run\ndevice: x#1\ndetection:\n  confidence_threshold: 0.4  # bar\n  ball_confidence_threshold: null\n  deep:\n    er: 'q: r'\n  after : 2\nball_tracking:\r\n  max_coast_frames: 7\n  max_coast_frames: 9\nmax_coast_frames: 1\n- item\n")
    (tmp_path / "b.yaml").write_text("ball_tracking:\n\tprocess_noise: 1e-1\n")
    (tmp_path / "empty.yaml").write_text("")
    got = sorted((r.job, r.path, r.value) for r in files.read_sections(spark, str(tmp_path)).collect())
    assert got == sorted([("a", "device", "x#1"), ("a", "detection.confidence_threshold", "0.4"), ("a", "detection.ball_confidence_threshold", "null"), ("a", "detection.deep.er", "q: r"), ("a", "detection.after", "2"), ("a", "ball_tracking.max_coast_frames", "7"), ("a", "ball_tracking.max_coast_frames", "9"), ("a", "max_coast_frames", "1"), ("b", "ball_tracking.process_noise", "1e-1")])
    rows = {r.job: r for r in files.read_sectioned_options(spark, str(tmp_path)).collect()}
    told = {job: files.Options(**{k: v for k, v in r.asDict().items() if k != "job"}) for job, r in rows.items()}
    assert told["a"] == files.Options(max_coast_frames=9, person_confidence=0.4) and told["b"] == files.Options(process_noise=0.1)
    assert told.get("empty", files.Options()) == files.Options()
