"""Golden formations and the cases in which code and prose, or pandas and Spark, part."""

import numpy as np
import pytest

from pitchflow import schema as S
from pitchflow.functions.geometry import fit_homography
from pitchflow.operators import detections as D
from pitchflow.operators import formation as M
from pitchflow.operators import tactics as A
from pitchflow.operators import tracks as T
from pitchflow.sources.position_log import read_csv, write_csv
from pitchflow.streaming import state as K

BACK = {10 + i: (20.0, y) for i, y in enumerate((10.0, 25.0, 43.0, 58.0))}
MID = {20 + i: (45.0, y) for i, y in enumerate((10.0, 25.0, 43.0, 58.0))}
FRONT = {30: (75.0, 25.0), 31: (75.0, 43.0)}


def log(spark, tracks, start=0, frames=200, extra=()):
    rows = []
    for team, t, x, y, a, n in [(0, 1, 2.0, 34.0, start, frames), (1, 90, 95.0, 34.0, start, frames), *((0, t, x, y, start, frames) for t, (x, y) in tracks.items()), *extra]:
        rows += [("clip", 0, f, t, "person", team, x * 10, y * 10, x, y, 100.0, False) for f in range(a, a + n)]
    return spark.createDataFrame([(c, i, *r) for i, (c, _, *r) in enumerate(rows)], S.POSITION_LOG)


def detected(spark, tracks, **kw):
    rows = log(spark, tracks, **kw)
    return M.detect(rows, T.clean_ball(rows)).filter("team = 0").first()


def test_clean_shape(spark):
    r = detected(spark, BACK | MID | FRONT)
    assert (r.label, r.confidence, r.goalkeeper, r.n_included) == ("4-4-2", "high", 1, 10)
    assert "track_fragmentation" not in r.caveats and [x.role for x in r.lines] == ["defense", "midfield", "attack"]


def test_fragments(spark):
    extra = [(0, 50 + i, 45.0, 30.0 + i, 200 + 10 * i, 8) for i in range(5)]
    r = detected(spark, BACK | MID | FRONT, extra=extra)
    assert (r.label, r.n_candidates, r.n_included) == ("4-4-2", 16, 10) and "track_fragmentation" in r.caveats


def test_deep_sweeper(spark):
    tracks = {10: (10.0, 34.0), 11: (19.5, 8.0), 12: (20.5, 34.0), 13: (21.5, 58.0), 30: (65.0, 25.0), 31: (67.0, 43.0)} | {20 + i: (35.0 + 2 * i, y) for i, y in enumerate((10.0, 25.0, 43.0, 58.0))}
    r = detected(spark, tracks)
    assert (r.label, r.confidence, r.threshold, r.goalkeeper) == ("4-4-2", "high", 10.0, 1) and set(r.lines[0].track_ids) == {10, 11, 12, 13}


def test_messy_play_takes_the_best_fit(spark):
    r = detected(spark, {10 + i: (20.0 + 2 * i, 10.0 + 12 * (i % 5)) for i in range(10)})
    assert (r.label, r.confidence) == ("4-2-3-1", "low") and "best-fit" in r.caveats


def track(spark, *rows):
    return spark.createDataFrame([("clip", f, float(x), 0.0) for f, x in rows], "clip_id string, frame bigint, x double, y double")


def test_long_gaps_get_their_first_ten_frames(spark):
    got = {r.frame: r.x for r in T.interpolate(track(spark, (0, 0), (15, 15))).collect()}
    assert sorted(got) == [*range(11), 15] and got[7] == 7.0
    assert T.interpolate(track(spark, (0, 0), (15, 15)), strict_gaps=True).count() == 2


def test_jump_filter_keeps_the_last_good_position(spark):
    rows = spark.createDataFrame([("clip", f, x, 0.0, s) for f, x, s in ((0, 0.0, 1.0), (1, 50.0, 1.0), (2, 8.0, 1.0), (3, 90.0, None))], "clip_id string, frame bigint, x double, y double, scale double")
    assert sorted(r.frame for r in T.jump_filter(rows).collect()) == [0, 2, 3]  # a null scale accepts


def held(spark, *rows):
    return spark.createDataFrame([("clip", f, t, team) for f, t, team in rows], "clip_id string, frame bigint, track_id bigint, team int")


def test_runs(spark):
    rows = held(spark, (0, 1, None), (5, 1, 1), (9, 1, 0), (10, 2, 1), (11, 1, 0), (12, 1, 0), (13, 1, 0))
    got = T.possession_runs(rows).orderBy("start_frame").collect()
    assert [(r.track_id, r.team, r.length) for r in got] == [(1, 1, 3), (1, 0, 3)]  # first team that isn't null; short run dropped, not merged
    assert T.passes(T.possession_runs(rows)).count() == 0 and T.touches(T.possession_runs(rows)).first().touches == 2


def test_hull():
    assert A.hull_area(np.array([0, 1, 2]), np.array([0, 1, 2])) == 0.0
    pts = np.array([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1)], float)
    assert all(A.hull_area(*pts[np.random.default_rng(k).permutation(5)].T) == 12.0 for k in range(5))


def test_vote_locks(spark):
    rows = spark.createDataFrame([("c", 7, i, x) for i, x in enumerate((1, 0, 0, None, 0, 1, 1, 1, 1))], "clip_id string, track_id bigint, seq bigint, label int")
    assert [r.team for r in D.team_votes(rows).orderBy("seq").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0]


def test_kalman_resets_and_streams_alike(spark, tmp_path):
    seen = [(0, 1.0), (1, 2.0), *((f, None) for f in range(2, 9)), (9, 50.0), (10, 51.0)]
    schema = "clip_id string, frame bigint, x double, y double"
    rows = spark.createDataFrame([("c", f, x, x) for f, x in seen], schema)
    batch = sorted(map(tuple, K.kalman(rows, max_coast=3).collect()))
    assert [r[1] for r in batch] == [0, 1, 2, 3, 4, 9, 10] and batch[5][2] == 50.0
    for k, part in enumerate((rows.filter("frame < 5"), rows.filter("frame >= 5"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = K.kalman_stream(stream, max_coast=3).writeStream.format("memory").queryName("kalman").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kalman").collect())) == batch


def followed(boxes, x, y, frame, frames=20, reach=40.0):
    out = []
    for k in range(1, frames + 1):
        rows = [b for b in boxes if b[1] == frame + k]
        inside = [((b[5] - b[3]) * (b[6] - b[4]), b[2], b) for b in rows if b[3] <= x <= b[5] and b[4] <= y <= b[6]]
        far = [(d, b[2], b) for b in rows if (d := ((b[3] + b[5]) / 2 - x) ** 2 + ((b[4] + b[6]) / 2 - y) ** 2) <= reach**2]
        if not inside and not far:
            break
        b = min(inside or far)[2]
        x, y = (b[3] + b[5]) / 2, (b[4] + b[6]) / 2
        out.append((frame + k, b[2]))
    return out


def test_follow_matches_brute_force(spark):
    r = np.random.default_rng(3)
    boxes = [("c", f, 10 * f + k, x - w, y - h, x + w, y + h) for f in range(240, 300) if f != 270 for k in range(6) for x, y, w, h in [map(float, r.integers(4, (120, 120, 20, 30)))]]
    b = spark.createDataFrame(boxes, "clip_id string, frame bigint, det_seq bigint, x1 double, y1 double, x2 double, y2 double")
    starts = [(i, "c", f, float(x), float(y)) for i, (f, x, y) in enumerate(zip(r.integers(230, 300, 80).tolist(), *r.integers(-60, 160, (2, 80)), strict=True))]
    s = spark.createDataFrame(starts, "start_id bigint, clip_id string, frame bigint, x double, y double")
    want = sorted((i, *p) for i, _, f, x, y in starts for p in followed(boxes, x, y, f))
    assert sorted(map(tuple, K.follow(b, s).collect())) == want and want


def test_all_persons_are_followed(spark):
    from pitchflow.plans import catalog

    rows = catalog.QUERIES["win_track_forward"](spark, "/root/testdata/sf0.001").select("start_id").distinct()
    log = catalog.log_of(spark, "/root/testdata/sf0.001").filter("class_name = 'person'")
    assert {x.start_id // 24 for x in rows.collect()} == {x.frame for x in log.select("frame").distinct().collect()} - {log.agg({"frame": "max"}).first()[0]}


def test_other_balls_stay_and_the_tracked_one_has_a_pitch_position(spark):
    rows = [("c", i, f, t, "sports ball", None, x, x, x / 10, x / 10, 9.0, False) for i, (f, t, x) in enumerate(((0, 7, 10.0), (0, 8, 90.0), (1, 8, 20.0)))]
    rows += [("c", 3 + f, f, 1, "person", 0, 5.0, 5.0, 0.5, 0.5, 99.0, False) for f in range(3)]
    game = spark.createDataFrame(rows, S.POSITION_LOG)
    out = K.ball_rows(game, K.kalman(K.observations(game)), np.diag([0.1, 0.1, 1.0]))
    assert out.columns == game.columns and out.count() == 7
    balls = {(r.frame, r.track_id): r for r in out.filter("class_name = 'sports ball'").collect()}
    assert set(balls) == {(0, -1), (0, 8), (1, -1), (2, -1)} and tuple(balls[0, 8]) == rows[1]
    assert all(r.pitch_x == pytest.approx(r.pixel_x / 10) and r.is_predicted == (f == 2) for (f, _), r in balls.items())
    assert T.raw_ball(out).count() == 3
    assert K.ball_rows(game, K.kalman(K.observations(game))).filter("track_id = -1 AND pitch_x IS NULL").count() == 3


def test_homography():
    h = np.array([[0.1, 0.01, 1], [0.0, 0.12, 2], [0.0001, 0.0002, 1]])
    px = np.array([(0, 0), (500, 0), (500, 400), (0, 400), (250, 100), (400, 300)], float)
    q = np.c_[px, np.ones(6)] @ h.T
    pitch = q[:, :2] / q[:, 2:]
    pitch[5] += 40
    assert np.allclose(fit_homography(px, pitch), h, atol=1e-6)
    with pytest.raises(ValueError):
        fit_homography(px[:3], pitch[:3])


def test_csv_round_trip(spark, tmp_path):
    rows = log(spark, FRONT, frames=3)
    write_csv(rows, str(tmp_path / "log"))
    back = read_csv(spark, str(tmp_path / "log")).drop("log_seq")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.drop("log_seq").collect()))


def test_keypoints():
    k = S.keypoints()
    assert len(k) == 29 and k[3][1:] == ("corner_bottom_right", 105.0, 68.0) and k[12][1] == "left_penalty_area_top_right" and k[28][2] == 94.0
