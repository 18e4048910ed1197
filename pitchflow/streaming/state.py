"""Operators that carry state from frame to frame, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchflow.functions.geometry import project
from pitchflow.operators.chunks import nearest, split_clips
from pitchflow.sources.files import stored

OUT = "clip_id string, frame bigint, x double, y double, is_observed boolean"
#: Frames of a task of follow(), and pairs of a point and a box that it compares at once.
CHUNK, PAIRS = 256, 1 << 20
STATE = "x double, y double, vx double, vy double, a double, b double, c double, missed bigint"


def kalman_step(state: tuple | None, x: float | None, y: float | None, max_coast: int, q: float, r: float) -> tuple[tuple | None, bool]:
    """One frame of the constant-velocity filter. Both axes share the covariance a, b, c, so it is three numbers."""
    seen = x is not None and x == x
    if state is None:
        return ((x, y, 0.0, 0.0, r, 0.0, r, 0) if seen else None), seen
    sx, sy, vx, vy, a, b, c, missed = state
    if not seen and missed + 1 > max_coast:
        return None, False
    sx, sy, a, b, c = sx + vx, sy + vy, a + 2 * b + c + q, b + c, c + q
    if not seen:
        return (sx, sy, vx, vy, a, b, c, missed + 1), False
    k1, k2 = a / (a + r), b / (a + r)
    dx, dy = x - sx, y - sy
    return (sx + k1 * dx, sy + k1 * dy, vx + k2 * dx, vy + k2 * dy, (1 - k1) * a, (1 - k1) * b, c - k2 * b, 0), True


def _run(p: pd.DataFrame, state: tuple | None, max_coast: int, q: float, r: float) -> tuple[list, tuple | None]:
    out = []
    for clip, frame, x, y in p.sort_values("frame")[["clip_id", "frame", "x", "y"]].itertuples(index=False):
        state, seen = kalman_step(state, x, y, max_coast, q, r)
        if state is not None:
            out.append((clip, frame, round(state[0], 6), round(state[1], 6), seen))
    return out, state


def kalman(observations: DataFrame, max_coast: int = 15, q: float = 5.0, r: float = 10.0) -> DataFrame:
    """``observations(clip_id, frame, x, y)``, one row a frame, x and y null where the ball wasn't seen.

    After more than ``max_coast`` frames unseen nothing of the past is left, so the rows from one such gap to the next
    are a segment, and segments are filtered apart. Frames go on to be coasted only as far as there are observations rows.
    """
    observations = stored(observations.select("clip_id", "frame", "x", "y"), "observations")
    last = observations.groupBy("clip_id").agg(F.max("frame").alias("last"))
    seen = observations.filter("x IS NOT NULL AND NOT isnan(x)").select("clip_id", "frame", "x", "y")
    split = split_clips(observations)
    seen = nearest(seen, F.col("frame"), "before", own=False, split=split)
    begins = F.col("before").isNull() | (F.col("frame") - F.col("before") - 1 > max_coast)
    seen = nearest(seen, F.when(begins, F.col("frame")), "segment", split=split).join(last, "clip_id")

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        frame, x, y = p["frame"].to_numpy(), p["x"].to_numpy(), p["y"].to_numpy()
        out, state = [], None
        for i, f in enumerate(frame.tolist()):
            state, _ = kalman_step(state, x[i], y[i], max_coast, q, r)
            out.append((f, round(state[0], 6), round(state[1], 6), True))
            for g in range(f + 1, min(int(frame[i + 1]) if i + 1 < len(frame) else f + max_coast + 1, int(p["last"].iloc[0]) + 1)):
                state, _ = kalman_step(state, None, None, max_coast, q, r)
                out.append((g, round(state[0], 6), round(state[1], 6), False))
        got = pd.DataFrame(out, columns=["frame", "x", "y", "is_observed"])
        got.insert(0, "clip_id", p["clip_id"].iloc[0])
        return got

    return seen.groupBy("clip_id", "segment").applyInPandas(fold, OUT)


def kalman_stream(observations: DataFrame, max_coast: int = 15, q: float = 5.0, r: float = 10.0) -> DataFrame:
    """The same over a stream whose micro-batches come in frame order; each is sorted by frame."""

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        held = None if held is None or held[0] is None else held
        p = pd.concat(list(parts))
        out, now = _run(p, held, max_coast, q, r)
        state.update(now if now is not None else (None,) * 8)
        yield pd.DataFrame(out, columns=["clip_id", "frame", "x", "y", "is_observed"])

    return observations.groupBy("clip_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def observations(log: DataFrame) -> DataFrame:
    """Raw ball positions on every frame of a clip, null where there is none."""
    ball = log.filter("class_name = 'sports ball'").groupBy("clip_id", "frame").agg(F.min_by(F.struct(F.col("pixel_x").alias("x"), F.col("pixel_y").alias("y")), "log_seq").alias("p")).select("clip_id", "frame", "p.*")
    spine = log.groupBy("clip_id").agg(F.max("frame").alias("last")).select("clip_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("frame"))
    return spine.join(ball, ["clip_id", "frame"], "left")


def ball_rows(log: DataFrame, tracked: DataFrame, h: np.ndarray | None = None) -> DataFrame:
    """The log with the tracked ball (track -1) in place of the row it was observed in, and coasted frames marked as predicted.

    Other balls of a frame keep their rows and ids. The tracked ball's pitch position is its pixel's through the
    homography ``h``, null without one.
    """
    known = log.filter("class_name = 'sports ball'").groupBy("clip_id", "frame").agg(F.min_by(F.struct("log_seq", "bbox_height"), "log_seq").alias("k"))
    seen = lambda c: F.when(F.col("is_observed"), F.col(f"k.{c}")).alias(c)
    rows = tracked.join(known, ["clip_id", "frame"], "left")
    none = F.lit(None).cast("double")
    px, py = (none, none) if h is None else project(h, F.col("x"), F.col("y"))
    ball = rows.select("clip_id", seen("log_seq"), "frame", F.lit(-1).cast("bigint").alias("track_id"), F.lit("sports ball").alias("class_name"), F.lit(None).cast("int").alias("team"), F.col("x").alias("pixel_x"), F.col("y").alias("pixel_y"), px.alias("pitch_x"), py.alias("pitch_y"), seen("bbox_height"), (~F.col("is_observed")).alias("is_predicted"))
    return log.join(ball.select("clip_id", "log_seq"), ["clip_id", "log_seq"], "left_anti").unionByName(ball)


def _picked(at: np.ndarray, frame: np.ndarray, box: np.ndarray, frames: np.ndarray, reach: float) -> np.ndarray:
    """For each point, the number of the box that it lands on in its frame, or -1; boxes are in order of frame, then of preference."""
    out = np.full(len(at), -1)
    centre, area = (box[:, :2] + box[:, 2:]) / 2, (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    if not len(at) or not len(box):
        return out
    order = np.argsort(frame, kind="stable")
    names, first = np.unique(frame[order], return_index=True)
    for rows, a, z in zip(np.split(order, first[1:]), np.searchsorted(frames, names), np.searchsorted(frames, names, "right"), strict=True):
        if a == z:
            continue
        for part in np.array_split(rows, 1 + len(rows) * int(z - a) // PAIRS):
            p = at[part][:, None]
            inside = (box[a:z, :2] <= p).all(axis=2) & (p <= box[a:z, 2:]).all(axis=2)
            size = np.where(inside, area[a:z], np.inf)
            d = np.sqrt(((centre[a:z] - p) ** 2).sum(axis=2))
            d = np.where(d <= reach, d, np.inf)
            out[part] = a + np.where(inside.any(axis=1), size.argmin(axis=1), np.where(np.isfinite(d).any(axis=1), d.argmin(axis=1), -1 - a))
    return out


def follow(boxes: DataFrame, starts: DataFrame, reach: float = 40.0, frames: int = 19) -> DataFrame:
    """From each start ``(start_id, clip_id, frame, x, y)``, a box of each of the next ``frames`` frames, until a miss:
    with the start's own box 20.

    ``boxes(clip_id, frame, det_seq, x1, y1, x2, y2)``. A frame's box is the smallest that contains the last
    centre, else that with the nearest centre within reach; ties go to the first. Where a box leads to depends on
    the box only, so each is looked up once, in chunks of CHUNK frames with the boxes that their starts can reach.
    """
    chunk = lambda c: F.floor(c / CHUNK)
    corners = ["x1", "y1", "x2", "y2"]
    near = boxes.select("clip_id", "frame", F.col("det_seq").alias("id"), *corners, F.lit(False).alias("starts"), F.explode(F.sequence(chunk(F.col("frame") - frames), chunk(F.col("frame") - 1))).alias("chunk"))
    from_ = starts.select("clip_id", "frame", F.col("start_id").alias("id"), *(F.col(c[0]).alias(c) for c in corners), F.lit(True).alias("starts"), chunk(F.col("frame")).alias("chunk"))

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["frame", "id"])
        s, b = p[p["starts"]], p[~p["starts"]]
        frame, seq, box, start = b["frame"].to_numpy(), b["id"].to_numpy(), b[corners].to_numpy(float), s["id"].to_numpy()
        now = _picked(s[corners[:2]].to_numpy(float), s["frame"].to_numpy() + 1, box, frame, reach)
        after, out = _picked((box[:, :2] + box[:, 2:]) / 2, frame + 1, box, frame, reach), []
        for _ in range(frames):
            start, now = start[now >= 0], now[now >= 0]
            out.append(pd.DataFrame({"start_id": start, "frame": frame[now], "det_seq": seq[now]}))
            now = after[now]
        return pd.concat(out)

    return near.unionByName(from_).groupBy("clip_id", "chunk").applyInPandas(chain, "start_id bigint, frame bigint, det_seq bigint")
