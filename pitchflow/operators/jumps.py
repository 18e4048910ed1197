"""The jump filter over chunks of a clip: what a chunk keeps depends on one row, the last that was kept before it.

From whichever row a fold goes on, it ends a chunk on one of few rows, as folds that keep the same row are one from
there. So each chunk tells its possible ends; those are the next chunk's possible starts, for which it
tells what it ends on; one row for each start chains the chunks; and with its true start a chunk keeps its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.operators.chunks import CLIP, chunk_of, split_clips
from pitchflow.sources.files import stored

#: A row: frame and place.
AT = ["at_frame", "at_x", "at_y"]
_AT = "at_frame bigint, at_x double, at_y double"
_KEY = f"{CLIP} string, chunk bigint"
COLUMNS = ["frame", "x", "y", "scale"]


class Fold:
    """The rows of one chunk, in order."""

    def __init__(self, p: pd.DataFrame, max_jump: float):
        p = p.sort_values("frame")
        self.clip, self.chunk, self.max_jump = p[CLIP].iloc[0], p["chunk"].iloc[0], max_jump
        self.frame, self.x, self.y, self.scale = (p[c].to_numpy(dtype=float if c != "frame" else np.int64) for c in COLUMNS)

    def next(self, frame: float, x: float, y: float, from_: int) -> int:
        """The first row from ``from_`` on that is near enough to the last one kept; the number of rows if none is."""
        step = 8
        while from_ < len(self.frame):
            a = slice(from_, from_ + step)
            far = np.sqrt((self.x[a] - x) ** 2 + (self.y[a] - y) ** 2) > self.max_jump * self.scale[a] * np.maximum(self.frame[a] - frame, 1)
            if not far.all():
                return from_ + int(far.argmin())
            from_, step = from_ + step, step * 2
        return from_

    def kept(self, start: tuple | None) -> list[int]:
        out = []
        at = 0 if start is None else self.next(*start, 0)
        while at < len(self.frame):
            out.append(at)
            at = self.next(self.frame[at], self.x[at], self.y[at], at + 1)
        return out

    def ends(self) -> list[int]:
        """The rows that a fold can end on, wherever it begins."""
        end = np.arange(len(self.frame))
        for i in range(len(end) - 2, -1, -1):
            to = self.next(self.frame[i], self.x[i], self.y[i], i + 1)
            end[i] = end[to] if to < len(end) else i
        return sorted(set(end.tolist()))

    def row(self, i: int) -> tuple:
        return int(self.frame[i]), float(self.x[i]), float(self.y[i])


def _start(row) -> tuple | None:
    return None if pd.isna(row[0]) else (int(row[0]), float(row[1]), float(row[2]))


def jump_filter(rows: DataFrame, max_jump: float) -> DataFrame:
    """``rows(clip_id, frame, x, y, scale)`` without those too far from the last one kept, for the frames between.

    A null scale keeps its row. Rows are written once; a log all of whose clips have one chunk is folded at once.
    """
    at = stored(rows.select(CLIP, "frame", "x", "y", F.col("scale").cast("double").alias("scale")).withColumn("chunk", chunk_of()), "ball")
    keys = [CLIP, "chunk"]

    def out(p: pd.DataFrame, start: tuple | None) -> pd.DataFrame:
        p = p.sort_values("frame")
        return p.iloc[Fold(p, max_jump).kept(start)][[CLIP, "frame", "x", "y"]]

    kept = f"{CLIP} string, frame bigint, x double, y double"
    if not split_clips(at):
        return at.groupBy(*keys).applyInPandas(lambda p: out(p, None), kept)
    chunks = stored(at.select(*keys).distinct(), "chunks")
    before = chunks.withColumn("before", F.lag("chunk").over(Window.partitionBy(CLIP).orderBy("chunk")))  # one row a chunk

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        fold = Fold(p, max_jump)
        return pd.DataFrame([(fold.clip, fold.chunk, *fold.row(i)) for i in fold.ends()], columns=[*keys, *AT])

    def mapped(p: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(starts):
            return pd.DataFrame(columns=[*keys, *AT, *(f"to_{c}" for c in AT)])
        fold, rows_ = Fold(p, max_jump), []
        for start in map(_start, starts[AT].itertuples(index=False)):
            went = fold.kept(start)
            rows_.append((fold.clip, fold.chunk, *(start or (None,) * 3), *(fold.row(went[-1]) if went else start)))
        return pd.DataFrame(rows_, columns=[*keys, *AT, *(f"to_{c}" for c in AT)]).astype({"at_frame": "Int64", "to_at_frame": "Int64"})

    next_ = stored(before.filter("before IS NOT NULL").select(CLIP, F.col("before").alias("chunk"), F.col("chunk").alias("next")), "next")
    firsts = before.filter("before IS NULL").select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in zip(AT, ("bigint", "double", "double"), strict=True)))
    # Starts that are to be tried; a fold that keeps no row of a chunk hands its start on to the next one.
    todo = stored(firsts.unionByName(at.groupBy(*keys).applyInPandas(ends, f"{_KEY}, {_AT}").join(next_, keys).select(CLIP, F.col("next").alias("chunk"), *AT)), "starts")
    done = None
    while not todo.isEmpty():
        now = at.groupBy(*keys).cogroup(todo.groupBy(*keys)).applyInPandas(mapped, f"{_KEY}, {_AT}, to_at_frame bigint, to_at_x double, to_at_y double")
        now = stored(now, "maps")
        done = now if done is None else done.unionByName(now)
        on = now.join(next_, keys).select(CLIP, F.col("next").alias("chunk"), *(F.col(f"to_{c}").alias(c) for c in AT)).distinct()
        todo = stored(on.join(done.select(*keys, *AT), [*keys, *AT], "left_anti"), "starts")

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        at_, rows_ = None, []
        for chunk, options in p.sort_values("chunk").groupby("chunk"):
            to = {_start(o[:3]): _start(o[3:]) for o in options[[*AT, *(f"to_{c}" for c in AT)]].itertuples(index=False)}
            rows_.append((p[CLIP].iloc[0], chunk, *(at_ or (None,) * 3)))
            at_ = to[at_]
        return pd.DataFrame(rows_, columns=[*keys, *AT]).astype({"at_frame": "Int64"})

    true = done.groupBy(CLIP).applyInPandas(chain, f"{_KEY}, {_AT}")

    def finish(p: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        return out(p, _start(starts[AT].iloc[0])) if len(p) else p[[CLIP, "frame", "x", "y"]]

    return at.groupBy(*keys).cogroup(true.groupBy(*keys)).applyInPandas(finish, kept)
