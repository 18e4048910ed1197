"""Many clips, chunks of a long clip, the order of CSV logs, clicks, votes as state and progress."""

import random

import pytest
from pyspark.sql import functions as F

from pitchflow.operators import chunks, jumps
from pitchflow.operators import detections as D
from pitchflow.operators import tracks as T
from pitchflow.plans import catalog
from pitchflow.sources import files
from pitchflow.sources.position_log import in_clips, read_csv, write_csv
from pitchflow.streaming import jobs, votes
from pitchflow.streaming import state as K
from pitchflow.streaming.association import BOX, associate

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def log(spark):
    return files.stored(catalog.log_of(spark, SF), "log")


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 7)


def test_a_log_under_two_clip_ids_gives_everything_twice(log):
    two = log.unionByName(log.withColumn("clip_id", F.lit("other")))
    sure = lambda x: D.detect(D.boxes(x), "sports ball")
    one_each = lambda x: D.best_of_singletons(D.boxes(x), ("sports ball", "ref"))
    tracks = lambda x: associate(D.boxes(x).filter("frame < 40").select("clip_id", "frame", "det_seq", *BOX, "confidence"))
    for f in (sure, one_each, tracks):
        assert f(two).count() == 2 * f(log).count()
    got = tracks(two)
    assert rows_of(got.filter("clip_id = 'other'").drop("clip_id")) == rows_of(got.filter("clip_id <> 'other'").drop("clip_id")) == rows_of(tracks(log).drop("clip_id"))


def brute_nearest(rows, after, own):
    out = []
    for c, f, v in rows:
        near = [(abs(g - f), w) for d, g, w in rows if d == c and w is not None and ((g > f if after else g < f) or (own and g == f))]
        out.append((c, f, v, min(near)[1] if near else None))
    return sorted(out, key=repr)


def test_nearest_and_running_sums_reach_over_chunks(spark, small_chunks):
    r = random.Random(4)
    rows = [(c, f, r.choice([None, None, f * 10])) for c in ("a", "b", None) for f in r.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "clip_id string, frame bigint, v bigint")
    for after in (False, True):
        for own in (False, True):
            got = chunks.nearest(df, F.col("v"), "near", after, own)
            assert got.columns == ["clip_id", "frame", "v", "near"] and sorted(map(tuple, got.collect()), key=repr) == brute_nearest(rows, after, own)
    got = chunks.running_sum(df, F.col("v"), "total").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((c, f, v, sum(w or 0 for d, g, w in rows if d == c and g <= f)) for c, f, v in rows), key=repr)
    assert chunks.nearest(df.filter("false"), F.col("v"), "near").count() == 0


def jumping(seed, n=400):
    r, x, out = random.Random(seed), 0.0, []
    for f in range(n):
        if r.random() < 0.3:
            continue
        x += r.uniform(-3, 3)
        y = r.choice([0.0] * 5 + [60.0, -200.0, 1000.0])  # another ball that is seen for a while, or noise
        out.append(("c", f, x, y if r.random() < 0.5 or y < 50 else 61.0, r.choice([1.0, 1.5, None])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_jump_filter_in_chunks(spark, monkeypatch, seed):
    rows = spark.createDataFrame(jumping(seed) + [("d", f, float(f % 90), 0.0, 1.0) for f in range(0, 300, 2)] + [("e", f, 500.0 * (f > 0), 0.0, 1e-9) for f in range(90)], "clip_id string, frame bigint, x double, y double, scale double")
    want = []
    for clip in "cde":
        last = None
        for r in sorted(rows.filter(f"clip_id = '{clip}'").collect(), key=lambda r: r.frame):
            if last is None or r.scale is None or not ((r.x - last.x) ** 2 + (r.y - last.y) ** 2) ** 0.5 > 5 * r.scale * max(r.frame - last.frame, 1):
                last = r
                want.append((clip, r.frame, r.x, r.y))
    assert len(want) < rows.count()
    for size in (1 << 14, 7):  # clip e keeps its first row only: its start is handed on through all chunks
        monkeypatch.setattr(chunks, "CHUNK", size)
        assert sorted(map(tuple, jumps.jump_filter(rows, 5.0).collect())) == sorted(want)


def test_long_clips_are_cut_alike(spark, log, monkeypatch):
    two = in_clips(log, 200)
    asked = {
        "ball": lambda: T.clean_ball(two, "pixel"), "runs": lambda: T.possession_runs(T.possessors(two)), "kalman": lambda: K.kalman(K.observations(two), max_coast=3),
        "gaps": lambda: T.interpolate(T.raw_ball(two), strict_gaps=True),
    }
    want = {k: rows_of(f()) for k, f in asked.items()}
    monkeypatch.setattr(chunks, "CHUNK", 9)
    assert {k: rows_of(f()) for k, f in asked.items()} == want and all(want.values())


def test_no_window_over_a_whole_clip(spark, log, capsys):
    T.interpolate(T.raw_ball(log)).explain()
    plan = capsys.readouterr().out
    assert all("_chunk" in line for line in plan.splitlines() if "Window [" in line and "_value" in line)


@pytest.mark.parametrize("by_clip", [False, True])
def test_csv_logs_keep_their_order(spark, log, tmp_path, by_clip):
    sizes, cut = [1, 900, 30, 2500, 4, 700, 5000], 0
    source = in_clips(log, 150) if by_clip else log
    for k, n in enumerate(sizes):  # seven parts of unlike sizes
        part = source.filter((F.col("log_seq") >= cut) & (F.col("log_seq") < (cut + n if k < 6 else 1 << 40))).coalesce(1)
        write_csv(part, str(tmp_path / "made"), by_clip)
        for i, f in enumerate(sorted((tmp_path / "made").rglob("*.csv"))):
            to = tmp_path / "log" / (f.parent.name if by_clip else "") / f"part-{k:05d}-{i:05d}.csv"
            to.parent.mkdir(parents=True, exist_ok=True)
            f.rename(to)
        cut += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # files are cut and packed
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        back = read_csv(spark, str(tmp_path / "log")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, n = {}, {}
    for r in source.orderBy("log_seq").collect():
        clip = r.clip_id if by_clip else "clip"
        want[clip, n.setdefault(clip, 0)] = (r.frame, r.track_id, r.pixel_x, r.pixel_y)
        n[clip] += 1
    assert {(r.clip_id, r.log_seq): (r.frame, r.track_id, r.pixel_x, r.pixel_y) for r in back} == want and len(back) == len(want)


def test_every_click_gets_its_box(spark):
    r = random.Random(8)
    boxes = [(c, f, i, *(x, y, x + r.randint(5, 200), y + r.randint(5, 300))) for i, (c, f, x, y) in enumerate((r.choice("ab"), r.randint(0, 3), r.uniform(-100, 600), r.uniform(-50, 400)) for _ in range(60))]
    boxes += [("a", 0, 100, 0.0, 0.0, 10.0, 10.0), ("a", 0, 101, 0.0, 0.0, 10.0, 10.0)]
    clicks = [(r.choice("ab"), r.randint(0, 4), k, r.uniform(-150, 700), r.uniform(-100, 500)) for k in range(300)] + [("a", 0, 300, 5.0, 5.0), ("a", 0, 301, 5.0, 5.0), ("a", 0, 302, 85.0, 5.0), ("a", 0, 303, None, 1.0)]
    want = {}
    for c, f, k, cx, cy in clicks:
        mine = [b for b in boxes if b[:2] == (c, f)] if cx is not None else []
        inside = [((b[5] - b[3]) * (b[6] - b[4]), b[2]) for b in mine if b[3] <= cx <= b[5] and b[4] <= cy <= b[6]]
        near = [(d, b[2]) for b in mine if (d := ((cx - (b[3] + b[5]) / 2) ** 2 + (cy - (b[4] + b[6]) / 2) ** 2) ** 0.5) <= 80]
        if inside or near:
            want[k] = (c, f, min(inside or near)[1], not inside)
    b = spark.createDataFrame(boxes, "clip_id string, frame bigint, det_seq bigint, x1 double, y1 double, x2 double, y2 double")
    got = D.click_boxes(spark.createDataFrame(clicks, "clip_id string, frame bigint, click_id bigint, cx double, cy double"), b)
    assert {x.click_id: (x.clip_id, x.frame, x.det_seq, x.by_centre) for x in got.collect()} == want and want[300] == want[301] == ("a", 0, 100, False)


def test_votes_as_state(spark):
    r = random.Random(2)
    seen = [(r.choice("ab"), r.randint(0, 6), i, r.choice([0, 0, 1, None])) for i in range(150)]
    df = spark.createDataFrame(seen, "clip_id string, track_id bigint, seq bigint, label int")
    with jobs.setting(spark, *votes.PROVIDER):
        got = jobs.in_parts([df.filter(F.col("seq").between(a, a + 29)) for a in range(0, 150, 30)], votes.team_vote_stream, "votes-test")
        assert rows_of(got) == rows_of(D.team_votes(df))
        lapsed = jobs.in_parts([df.filter("seq < 60"), df.filter("seq >= 60")], lambda s: votes.team_vote_stream(s, expire_seconds=1e-3), "votes-lapsed", once=True)
        early, late = df.filter("seq < 60"), df.filter("seq >= 60")
        assert rows_of(lapsed) == sorted(rows_of(D.team_votes(early)) + rows_of(D.team_votes(late)))  # a track that comes back votes anew


def test_progress_of_a_stream(spark, tmp_path):
    told = []
    df = spark.range(100).withColumn("part", F.floor(F.col("id") / 25))
    with jobs.listening(spark, jobs.JobProgress(told=lambda *x: told.append(x))) as listener:
        listener.expect("job", 100)
        assert listener.fraction("job") is None
        for k in range(4):
            df.filter(F.col("part") == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = stream.writeStream.format("noop").queryName("job").option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        broken = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*")).select(F.raise_error(F.lit("no")).alias("x"))
        q = broken.writeStream.format("noop").queryName("broken").option("checkpointLocation", str(tmp_path / "broken")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no"):
            q.awaitTermination(120)
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if "broken" in listener.errors:
                break
            __import__("time").sleep(0.1)
    mine = [f for n, f, e in told if n == "job"]
    assert [f for f in mine if f is not None] == [0.2125, 0.375, 0.5375, 0.7, 0.7] and "broken" in listener.errors


def test_vote_state_goes_to_python_in_batches(spark):
    """A call to the state for each track made the time of a batch grow with its tracks: no plan has it, and many tracks come back right."""
    from pitchflow.sources.files import scratch

    df = spark.range(6000).selectExpr("'a' AS clip_id", "id % 1500 AS track_id", "id AS seq", "CAST(id % 7 % 2 AS INT) AS label")
    path = scratch(spark, "votes-many")
    df.write.parquet(path)
    plan = votes.team_vote_stream(spark.readStream.schema(df.schema).parquet(path))._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan
    with jobs.setting(spark, *votes.PROVIDER):
        got = jobs.in_parts([df.filter("seq < 3000"), df.filter("seq >= 3000")], lambda s: votes.team_vote_stream(s, votes=3), "votes-batches")
        assert rows_of(got) == rows_of(D.team_votes(df, votes=3))


def test_filters_on_positions_do_not_repeat_how_these_are_made(spark):
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("% 401")
    whole = catalog.log_of(spark, SF)
    assert made(T.players(whole).filter(T.within(5.0))) <= made(whole)


def test_rings_and_passes_come_from_one_possession(spark, monkeypatch):
    calls = []
    possessors = T.possessors
    monkeypatch.setattr(T, "possessors", lambda log: calls.append(log) or possessors(log))
    catalog.QUERIES["clips_pass_overlay"](spark, SF)
    assert len(calls) == 1
