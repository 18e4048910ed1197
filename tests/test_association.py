"""Tracks by matching predicted boxes, nearest anchors in blocks, and what is taken of a model's boxes."""

import itertools
import random

import numpy as np
import pytest

from pitchflow.operators import chunks
from pitchflow.operators import detections as D
from pitchflow.operators import tracks as T
from pitchflow.plans import pixels
from pitchflow.streaming.association import Tracks, assign, associate, segments


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 6, 2)
    score = np.where(r.random((n, m)) < 0.6, r.random((n, m)), 0.0)
    gain = np.clip(score - 0.2, 0, None)
    wide = gain if n <= m else gain.T
    best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    got = assign(score, 0.2)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and sum(gain[i, j] for i, j in got) == pytest.approx(best)


def boxes(spark, rows):
    schema = "clip_id string, frame bigint, det_seq bigint, x1 double, y1 double, x2 double, y2 double, confidence double"
    return spark.createDataFrame([(c, f, i, x, y, x + 30.0, y + 60.0, p) for i, (c, f, x, y, p) in enumerate(rows)], schema)


def test_crossing_players_keep_their_tracks(spark):
    rows, who = [], []
    for clip in ("a", "b"):
        for f in range(60):
            for k, (x, v) in enumerate(((0.0, 5.0), (300.0, -5.0))):
                if k == 0 and 40 <= f < 46:
                    continue  # hidden for a while
                rows.append((clip, f, x + v * f, 2.0 * k, 0.15 if f == 20 else 0.9))
                who.append((clip, k))
    got = {r.det_seq: (r.clip_id, r.track_id) for r in associate(boxes(spark, rows)).collect()}
    assert len(got) == len(rows)
    names = {w: {got[i] for i in range(len(rows)) if who[i] == w} for w in set(who)}
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == 4


def test_doubtful_boxes_start_no_track_and_empty_tables_stay_empty(spark):
    b = boxes(spark, [("a", 0, 0.0, 0.0, 0.2), ("a", 1, 0.0, 0.0, 0.9), ("a", 2, 0.0, 0.0, 0.15), ("a", 3, 500.0, 0.0, 0.15)])
    assert {r.det_seq: r.track_id for r in associate(b).collect()} == {0: -1, 1: 1, 2: 1, 3: -1}
    assert associate(b.filter("false")).count() == 0


def test_association_does_not_depend_on_batches(spark):
    rows = [("a", f, 40.0 * k + 3.0 * f, 100.0 * (k % 3), 0.9) for f in range(50) for k in range(6)]
    want = sorted(map(tuple, associate(boxes(spark, rows)).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, associate(boxes(spark, rows)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nearest_anchor_in_blocks(spark, monkeypatch):
    r = random.Random(1)
    vectors, anchors = [(i, [r.randint(0, 9) for _ in range(3)]) for i in range(50)], [(i, [r.randint(0, 9) for _ in range(3)]) for i in range(20)]
    want = {i: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in anchors) for i, v in vectors}
    frames = spark.createDataFrame(vectors, "vec_id bigint, vec array<bigint>"), spark.createDataFrame(anchors, "anchor_label int, anchor array<bigint>")
    for size in (1000, 3):
        monkeypatch.setattr(D, "ANCHORS", size)
        assert {x.vec_id: (x.d2, x.label) for x in D.nearest_anchor(*frames).collect()} == want
    assert D.nearest_anchor(frames[0], frames[1].filter("false")).count() == 0


def test_boxes_that_overlap_surer_ones_go(spark):
    rows = [(0, 1, 1, "person", 0.0, 0.0, 10.0, 10.0, 0.9), (0, 2, 1, "person", 1.0, 0.0, 11.0, 10.0, 0.8), (0, 3, 1, "person", 20.0, 0.0, 30.0, 10.0, 0.5), (0, 4, 1, "ball", 0.0, 0.0, 10.0, 10.0, 0.2), (0, 5, 1, "ball", 50.0, 0.0, 60.0, 10.0, 0.15), (1, 6, 1, "person", 0.0, 0.0, 10.0, 10.0, 0.2)]
    b = spark.createDataFrame([(c, *r) for c in "ab" for r in rows], "clip_id string, frame bigint, det_seq bigint, track_id bigint, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert sorted((r.clip_id, r.det_seq) for r in D.detect(b, "ball").collect()) == [(c, i) for c in "ab" for i in (1, 3, 4)]


def test_class_maps_and_progress(spark):
    assert D.parse_class_map("1:0, 3:1,") == {1: 0, 3: 1} and D.parse_class_map("") == {}
    with pytest.raises(ValueError):
        D.parse_class_map("1-0")
    lines = spark.createDataFrame([(1, 0, "frame 50: x"), (1, 1, "frame 100: x"), (2, 0, "other"), (3, 0, "frame 900: x")], "job bigint, seq bigint, line string")
    from pyspark.sql import functions as F

    assert {r.job: r.progress for r in D.progress(lines, F.lit(200)).collect()} == {1: 0.375, 2: None, 3: 0.7}


def test_folds_run_clip_by_clip(spark):
    log = pixels.in_clips(pixels.log_of(spark, "/root/testdata/sf0.01"), 100)
    clips = log.select("clip_id").distinct().count()
    assert clips == 5
    for one in ("clip0", "clip3"):  # a clip's track is what it is alone
        track = lambda df: sorted(map(tuple, T.clean_ball(df, "pixel").filter(f"clip_id = '{one}'").collect()))  # noqa: B023, E731
        assert track(log) == track(log.filter(f"clip_id = '{one}'"))


def test_segments_give_the_rows_of_one_fold(spark, monkeypatch):
    """Clips with gaps, doubtful boxes around them and a null clip, against one pass of a clip's frames, ids included."""
    r, rows = random.Random(5), []
    for clip in ("a", "b", None):
        f = 0
        for _ in range(60):
            f += r.choice([1, 1, 1, 2, 4, 5, 6, 7, 12])
            for k in range(r.randint(1, 3)):
                rows.append((clip, f, 100.0 * k + f, 0.0, r.choice([0.05, 0.15, 0.3, 0.9])))
    want, cut = {}, {}
    for clip in ("a", "b", None):
        tracks = Tracks()
        mine = [(i, x) for i, x in enumerate(rows) if x[0] == clip]
        for f, group in itertools.groupby(mine, key=lambda x: x[1][1]):
            group = list(group)
            box = np.array([[x[2], x[3], x[2] + 30.0, x[3] + 60.0] for _, x in group])
            ids = tracks.step(f, box, np.array([x[4] for _, x in group]), 0.25, 0.1, 5, 0.2, 0.5)
            want.update({i: (clip, f, int(t)) for (i, _), t in zip(group, ids, strict=True)})
        cut[clip] = tracks.made
    for size in (1 << 14, 16):
        monkeypatch.setattr(chunks, "CHUNK", size)
        b = boxes(spark, rows)
        assert {x.det_seq: (x.clip_id, x.frame, x.track_id) for x in associate(b, buffer=5).collect()} == want
        begins = segments(b, 0.1, 5).select("clip_id", "segment").distinct().collect()
        assert len(begins) > 9 and {x.clip_id for x in begins} == {"a", "b", None} and min(cut.values()) > 3


def test_unbroken_segments_are_split_and_give_the_rows_of_one_fold(spark, monkeypatch):
    """Boxes on every frame are one segment; its parts, some of them begun with other tracks than they should, give one pass's ids."""
    from pitchflow.streaming import association

    r, rows = random.Random(8), []
    for clip in ("a", None):
        for f in range(300):
            rows.append((clip, f, 1.5 * f, 0.0, 0.9))  # never forgotten
            rows += [(clip, f, 300.0 + 120 * k + r.uniform(-20, 20), 400.0 + r.uniform(-20, 20), r.choice([0.15, 0.3, 0.9])) for k in range(4)]
    want = {}
    for clip in ("a", None):
        tracks, mine = Tracks(), [(i, x) for i, x in enumerate(rows) if x[0] == clip]
        for f, group in itertools.groupby(mine, key=lambda x: x[1][1]):
            group = list(group)
            box = np.array([[x[2], x[3], x[2] + 30.0, x[3] + 60.0] for _, x in group])
            ids = tracks.step(f, box, np.array([x[4] for _, x in group]), 0.25, 0.1, 5, 0.2, 0.5)
            want.update({i: (clip, f, int(t)) for (i, _), t in zip(group, ids, strict=True)})
    b = boxes(spark, rows)
    assert segments(b, 0.1, 5).select("clip_id", "segment").distinct().count() == 2
    runs = []
    folded = association._folded
    monkeypatch.setattr(association, "_folded", lambda rows, step: runs.append(rows.select("clip_id", "segment", "run").distinct().count()) or folded(rows, step))
    for part, warm in ((64, 16), (32, 0)):
        monkeypatch.setattr(association, "PART", part)
        monkeypatch.setattr(association, "WARM", warm)
        runs.clear()
        assert {x.det_seq: (x.clip_id, x.frame, x.track_id) for x in associate(b, buffer=5).collect()} == want
        assert runs[0] >= 2 * (300 // part) and len(runs) > 1


@pytest.mark.parametrize("seed", range(20))
def test_small_groups_are_matched_as_large_ones(seed):
    from pitchflow.streaming.association import _optimal, _optimal_small

    r = np.random.default_rng(seed)
    n = r.integers(1, 6)
    gain = np.round(r.random((n, n + r.integers(0, 3))), 1)  # with ties
    assert _optimal_small(gain.tolist()) == _optimal(gain)
