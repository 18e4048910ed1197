"""Track identities by two-stage matching of predicted boxes: sure boxes first, then doubtful ones (after ByteTrack, Zhang et al., 2022)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.operators.chunks import nearest, running_sum, split_clips
from pitchflow.sources.files import stored

BOX = ["x1", "y1", "x2", "y2"]
#: Standard deviations of a box's place and of its speed, in heights of the box.
PLACE, SPEED = 1 / 20, 1 / 160
KEY = ["clip_id", "frame"]
#: Frames of a part of a segment, and of the frames before it that its task goes through first.
PART, WARM = 4096, 768
#: Entries of a group's matrix up to which plain numbers are quicker than arrays.
SMALL = 64


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return both / np.maximum(size(a)[:, None] + size(b)[None] - both, 1e-9)


def _optimal_small(gain: list[list[float]]) -> list[tuple[int, int]]:
    """``_optimal`` of a small matrix, by the same steps without arrays."""
    n, m = len(gain), len(gain[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        best, way, used = [np.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j] = True
            g, at, to, step = gain[row_of[j] - 1], row_of[j], 0, np.inf
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -g[k - 1] - u[at] - v[k]
                    if cost < best[k]:
                        best[k], way[k] = cost, j
                    if best[k] < step:
                        to, step = k, best[k]
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    best[k] -= step
            j = to
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    return [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]


def _optimal(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the greatest sum of gains, by shortest augmenting paths; rows at most columns."""
    n, m = gain.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        best, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j]:
            used[j] = True
            cost = -gain[row_of[j] - 1] - u[row_of[j]] - v[1:]
            nearer = ~used[1:] & (cost < best[1:])
            best[1:][nearer], way[1:][nearer] = cost[nearer], j
            to = 1 + int(np.where(used[1:], np.inf, best[1:]).argmin())
            step = best[to]
            u[row_of[used]] += step
            v[used] -= step
            best[~used] -= step
            j = to
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    return [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]


def assign(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The matching with the greatest sum of what scores are above ``least``; each row and column once.

    Pairs that compete with no other are taken at once, the others are matched group by group.
    """
    gain = np.clip(score - least, 0, None)
    rows_of, cols_of = {}, {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(gain)), strict=True):
        cols_of.setdefault(i, []).append(j)
        rows_of.setdefault(j, []).append(i)
    out, done = [], set()
    for i, near in cols_of.items():
        if i in done:
            continue
        if len(near) == 1 and len(rows_of[near[0]]) == 1:
            out.append((i, near[0]))
            continue
        rows, cols, fresh = {i}, set(), [i]
        while fresh:
            for j in cols_of[fresh.pop()]:
                if j not in cols:
                    cols.add(j)
                    fresh += [k for k in rows_of[j] if k not in rows]
                    rows.update(rows_of[j])
        done |= rows
        r, c = sorted(rows), sorted(cols)
        part = gain[np.ix_(r, c)]
        wide = part if len(r) <= len(c) else part.T
        pairs = _optimal_small(wide.tolist()) if wide.size <= SMALL else _optimal(wide)
        out += [(r[i], c[j]) for i, j in (pairs if wide is part else ((i, j) for j, i in pairs)) if part[i, j] > 0]
    return sorted(out)


class Tracks:
    """The tracks of one segment of a clip: centre and size with their speeds, by a constant-velocity filter of one covariance a track."""

    def __init__(self):
        self.ids, self.seen = np.zeros(0, dtype=int), np.zeros(0, dtype=int)
        self.at, self.speed, self.cov = np.zeros((0, 4)), np.zeros((0, 4)), np.zeros((0, 3))
        self.frame, self.made = None, 0

    def state(self) -> bytes:
        """All that the frames to come depend on, but for the tracks' numbers; nothing before the first frame."""
        return b"" if self.frame is None else np.concatenate([[self.frame], np.column_stack([self.seen, self.at, self.speed, self.cov]).ravel()]).tobytes()

    def take_up(self, state: bytes) -> None:
        if state:
            numbers = np.frombuffer(state)
            told = numbers[1:].reshape(-1, 12)
            self.frame, self.seen = int(numbers[0]), told[:, 0].astype(int)
            self.at, self.speed, self.cov = told[:, 1:5].copy(), told[:, 5:9].copy(), told[:, 9:].copy()
            self.ids = np.zeros(len(told), dtype=int)

    def enter(self) -> None:
        """From here on tracks of before are named -2, -3 and so on, by their places, and those made from 1."""
        self.ids, self.made = -2 - np.arange(len(self.ids)), 0

    def _keep(self, rows: np.ndarray) -> None:
        for name in ("ids", "seen", "at", "speed", "cov"):
            setattr(self, name, getattr(self, name)[rows])

    def _predict(self) -> None:
        self.at = self.at + self.speed
        a, b, c = self.cov.T
        h = self.at[:, 3]
        self.cov = np.stack([a + 2 * b + c + (PLACE * h) ** 2, b + c, c + (SPEED * h) ** 2], axis=1)

    def boxes(self) -> np.ndarray:
        return np.concatenate([self.at[:, :2] - self.at[:, 2:] / 2, self.at[:, :2] + self.at[:, 2:] / 2], axis=1)

    def step(self, frame: int, box: np.ndarray, confidence: np.ndarray, sure: float, doubtful: float, buffer: int, least: float, least_doubtful: float) -> np.ndarray:
        """Track numbers of the boxes of one frame, -1 for none."""
        last, self.frame = self.frame, frame
        for _ in range(0 if last is None else min(frame - last, buffer + 1)):
            self._predict()
        self._keep(frame - self.seen <= buffer)
        out, free_box, found = np.full(len(box), -1), np.full(len(box), True), np.concatenate([(box[:, :2] + box[:, 2:]) / 2, box[:, 2:] - box[:, :2]], axis=1)
        free = np.arange(len(self.ids))
        for first in (True, False):
            cols = np.flatnonzero(confidence >= sure if first else (confidence < sure) & (confidence >= doubtful))
            rows = free if first else free[self.seen[free] == last]  # only tracks of the frame before go on by doubtful boxes
            if not len(rows) or not len(cols):
                continue
            score = overlaps(self.boxes()[rows], box[cols])
            pairs = assign(score * confidence[cols] if first else score, least if first else least_doubtful)
            if pairs:
                i, j = np.array(pairs).T
                self._update(rows[i], found[cols[j]], frame)
                out[cols[j]], free_box[cols[j]] = self.ids[rows[i]], False
            free = free[self.seen[free] < frame]
        new = np.flatnonzero(free_box & (confidence >= sure + 0.1))
        if len(new):
            out[new] = self.made + 1 + np.arange(len(new))
            self.made += len(new)
            h = found[new][:, 3]
            cov = np.stack([(2 * PLACE * h) ** 2, np.zeros(len(new)), (10 * SPEED * h) ** 2], axis=1)
            self.ids, self.seen = np.concatenate([self.ids, out[new]]), np.concatenate([self.seen, np.full(len(new), frame)])
            self.at, self.speed, self.cov = np.concatenate([self.at, found[new]]), np.concatenate([self.speed, np.zeros((len(new), 4))]), np.concatenate([self.cov, cov])
        return out

    def _update(self, rows: np.ndarray, seen: np.ndarray, frame: int) -> None:
        a, b, c = self.cov[rows].T
        r = (PLACE * self.at[rows, 3]) ** 2
        k1, k2 = a / (a + r), b / (a + r)
        off = seen - self.at[rows]
        self.at[rows] += k1[:, None] * off
        self.speed[rows] += k2[:, None] * off
        self.cov[rows] = np.stack([(1 - k1) * a, (1 - k1) * b, c - k2 * b], axis=1)
        self.seen[rows] = frame


def segments(boxes: DataFrame, least: float, buffer: int) -> DataFrame:
    """``(clip_id, frame, segment)``: the frame that each frame's segment begins on, -1 before the first.

    A track is dropped once it wasn't seen for more than ``buffer`` frames. After so many frames without a box from
    ``least``, the lowest confidence that a track goes on with, no track is left, and what follows is a segment of its own.
    """
    frames = stored(boxes.groupBy(*KEY).agg(F.max("confidence").alias("best")), "frames")
    split, sighted = split_clips(frames), F.col("best") >= least
    at = nearest(frames, F.when(sighted, F.col("frame")), "before", own=False, split=split)
    begins = sighted & (F.col("before").isNull() | (F.col("frame") - F.col("before") > buffer))
    at = nearest(at, F.when(begins, F.col("frame")), "segment", split=split)
    return at.select(*KEY, F.coalesce("segment", F.lit(-1)).alias("segment"))


def _beside(rows: DataFrame, told: DataFrame, *on: str) -> DataFrame:
    """``rows`` with the other columns of ``told``, one row for each ``on``; a null clip is a clip like any other."""
    other = told.withColumnsRenamed({c: f"_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same).drop(*(f"_{c}" for c in on))


FOLDED = "clip_id string, frame bigint, det_seq bigint, segment bigint, part bigint, number bigint, entered binary, departed binary, ids array<bigint>"


def _folded(rows: DataFrame, step: Callable[..., np.ndarray]) -> DataFrame:
    """Goes through each ``run`` of rows of a clip's segment frame by frame, in the order of a sort.

    A row of a box gives its number in its part; boxes that aren't its ``own`` only warm up. A row with ``start`` has the state that a
    run takes up. After each part comes a row with its first frame, how many tracks it made, the states that it began and
    ended with, and the numbers of the tracks that it ended with.
    """
    schema = pa.schema([("clip_id", pa.string()), *((c, pa.int64()) for c in ("frame", "det_seq", "segment", "part", "number")), ("entered", pa.binary()), ("departed", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part, tracks, held = None, None, Tracks(), None

        def over() -> Iterator[pa.RecordBatch]:
            if part is not None:
                told = [run[0], part[1], None, run[1], part[0], tracks.made, part[2], tracks.state(), tracks.ids.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(told, schema, strict=True)], schema=schema)

        def through(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal run, part, tracks
            number = np.full(len(t), -1)
            clip, starts, own = t["clip_id"].to_pylist(), t["start"], t["own"].to_numpy(zero_copy_only=False)
            segment, run_, part_, frame = (t[c].to_numpy() for c in ("segment", "run", "part", "frame"))
            box, confidence = np.column_stack([t[c].to_numpy() for c in BOX]), t["confidence"].to_numpy()
            first = _changes(t)
            for a, z in zip(first, [*first[1:], len(t)], strict=True):
                now = (clip[a], int(segment[a]), int(run_[a]))
                if now != run:
                    yield from over()
                    run, part, tracks = now, None, Tracks()
                if starts[a].is_valid:
                    tracks.take_up(starts[a].as_py())
                    continue
                if own[a] and (part is None or part[0] != int(part_[a])):
                    yield from over()
                    part = (int(part_[a]), int(frame[a]), tracks.state())
                    tracks.enter()
                number[a:z] = step(tracks, int(frame[a]), box[a:z], confidence[a:z])
            mine = t.append_column("number", pa.array(number)).filter(pa.array(own & starts.is_null().to_numpy()))
            for b in mine.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([b.column(f.name) if f.name in mine.column_names else pa.nulls(len(b), f.type) for f in schema], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            last = _changes(t)[-1] if len(t) else 0  # its frame may go on in the next batch
            held = t.slice(last)
            if last:
                yield from through(t.slice(0, last))
        if held is not None and len(held):
            yield from through(held)
        yield from over()

    ordered = rows.repartition("clip_id", "segment", "run").sortWithinPartitions("clip_id", "segment", "run", F.col("start").isNull(), "frame", "det_seq")
    return ordered.mapInArrow(fold, FOLDED)


def _changes(t: pa.Table) -> list[int]:
    """The first row of each frame of a run; a row with a state is one of its own."""
    keys = [pd.factorize(t["clip_id"].to_pandas())[0], *(t[c].to_numpy() for c in ("segment", "run", "frame")), t["start"].is_null().to_numpy()]
    new = np.full(len(t), False)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new).tolist()


_PART = ["clip_id", "segment", "part"]


def _rerun(rows: DataFrame, told: DataFrame, step: Callable[..., np.ndarray], span: int) -> DataFrame | None:
    """The parts that began with another state than the part before ended with, folded again from there; None if there is none.

    ``span`` parts are gone through as one run from the first such part on, so that what never forgets how it began
    isn't gone through once for each part.
    """
    of = Window.partitionBy("clip_id", "segment").orderBy("part")  # one row a part
    at = told.select(*_PART, "entered", "departed").withColumns({"before": F.lag("departed").over(of), "run": F.floor((F.row_number().over(of) - 1) / span)})
    off = at.filter("before IS NOT NULL AND before <> entered").groupBy("clip_id", "segment", "run").agg(F.min("part").alias("first"), F.min_by("before", "part").alias("start"))
    off = stored(off, "unlike")
    if off.isEmpty():
        return None
    again = _beside(at.select(*_PART, "run"), off.select("clip_id", "segment", "run", "first"), "clip_id", "segment", "run").filter("part >= first").select(*_PART, "run")
    own = _beside(rows, again, *_PART).withColumns({"own": F.lit(True), "start": F.lit(None).cast("binary")})
    starts = off.withColumn("own", F.lit(True)).withColumnRenamed("first", "part")
    return _folded(own.unionByName(starts, allowMissingColumns=True), step)


def _names(told: DataFrame) -> DataFrame:
    """``(clip_id, segment, part, round, before, carried)``: the tracks that the clip made before a part, and the numbers of those that it began with."""
    told = told.select(*_PART, "round", "frame", F.col("number").alias("made"), "ids")
    told = stored(running_sum(told, F.col("made"), "upto").select(*_PART, "round", "frame", (F.col("upto") - F.col("made")).alias("before"), "ids"), "parts")
    of = Window.partitionBy("clip_id", "segment")
    sized = told.withColumn("parts", F.count("*").over(of))

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        out, carried = [], []
        p = p.sort_values("part")
        for before, ids in zip(p["before"].tolist(), p["ids"].tolist(), strict=True):
            out.append(carried)
            carried = [int(i) + before if i > 0 else carried[-2 - int(i)] for i in ids]
        return p[[*_PART, "round", "before"]].assign(carried=out)

    named = "clip_id string, segment bigint, part bigint, round int, before bigint, carried array<bigint>"
    one = sized.filter("parts = 1").select(*_PART, "round", "before", F.array().cast("array<bigint>").alias("carried"))
    return one.unionByName(sized.filter("parts > 1").drop("parts").groupBy("clip_id", "segment").applyInPandas(chain, named))


def associate(boxes: DataFrame, sure: float = 0.25, buffer: int = 30, least: float = 0.2, doubtful: float = 0.1, least_doubtful: float = 0.5) -> DataFrame:
    """``boxes(clip_id, frame, det_seq, x1, y1, x2, y2, confidence)`` to ``(clip_id, frame, det_seq, track_id)``.

    Boxes with confidence from ``sure`` are matched first, by overlap times confidence, with all tracks of the last
    ``buffer`` frames where they are expected; then doubtful ones, by overlap, with what is left of the frame before.
    Sure boxes without a track start one; tracks are numbered by clip, in the order in which they start. A clip is cut
    into ``segments`` that no track reaches over, a segment into parts of PART frames, and these are spread over tasks: a task goes
    through its parts frame by frame in the order of a sort and holds one batch and one part's tracks.

    A part is begun WARM frames early without tracks, as tracks soon don't tell any more how they began. Whether its state on its
    first frame is that which the part before ended with, is checked to the last bit; where it isn't, the part is folded
    again from that state, until all parts fit. Tracks are numbered in each part at first: what the parts before
    made is added, and tracks that go on take their numbers along, from one row a part.
    """
    step = lambda tracks, frame, box, confidence: tracks.step(frame, box, confidence, sure, doubtful, buffer, least, least_doubtful)
    boxes = boxes.select(*KEY, "det_seq", *(F.col(c).cast("double").alias(c) for c in (*BOX, "confidence")))
    rows = _beside(boxes, segments(boxes, min(sure, doubtful), buffer), *KEY).withColumn("part", F.floor(F.col("frame") / PART))
    early = F.when(F.pmod("frame", F.lit(PART)) >= PART - WARM, F.array("part", F.col("part") + 1)).otherwise(F.array("part"))
    warmed = rows.withColumn("to", F.explode(early)).withColumns({"own": F.col("to") == F.col("part"), "part": F.col("to"), "run": F.col("to"), "start": F.lit(None).cast("binary")}).drop("to")
    rounds, again, told, span = [], _folded(warmed, step), None, 1
    while again is not None:
        done = stored(again, "tracked").withColumn("round", F.lit(len(rounds)))
        rounds.append(done.filter("departed IS NULL").select(*_PART, "round", "frame", "det_seq", "number"))
        fresh = done.filter("departed IS NOT NULL").drop("det_seq")
        both = fresh if told is None else told.unionByName(fresh)
        latest = Window.partitionBy(*_PART).orderBy(F.desc("round"))
        told = stored(both.withColumn("_k", F.row_number().over(latest)).filter("_k = 1").drop("_k"), "told")
        again = _rerun(rows, told, step, span)
        span *= 4
    found = rounds[0]
    for other in rounds[1:]:
        found = found.unionByName(other)
    number = F.when(F.col("number") > 0, F.col("number") + F.col("before")).when(F.col("number") < -1, F.get("carried", -2 - F.col("number"))).otherwise(F.col("number"))
    return _beside(found, _names(told), *_PART, "round").select(*KEY, "det_seq", number.alias("track_id"))
