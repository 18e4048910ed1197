"""What a row needs from the rows around it in a long clip, in two levels: inside a chunk of frames, then over one row a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLIP = "clip_id"
#: Frames of a chunk: a task sorts one at a time, and what reaches over borders is one row for each.
CHUNK = 1 << 14


def chunk_of(order: str = "frame") -> Column:
    return F.floor(F.col(order) / CHUNK).cast("bigint")


#: A chunk of a clip; a null clip is one like any other. Rows are dealt by these once, and what is told of a chunk comes back by them.
_OF = ["_key", "_none", "_chunk"]


def _placed(rows: DataFrame, value: Column, order: str) -> DataFrame:
    return rows.withColumns({"_value": value, "_key": F.coalesce(CLIP, F.lit("")), "_none": F.col(CLIP).isNull(), "_chunk": chunk_of(order)})


def _told(at: DataFrame, carried: Column) -> DataFrame:
    """``_carried`` of each chunk, from one row a chunk."""
    return at.groupBy(*_OF).agg(F.first("_edge").alias("_edge")).select(*_OF, carried.alias("_carried"))


def split_clips(rows: DataFrame, order: str = "frame") -> bool:
    """Whether a clip of ``rows``, a small written table, has more than one chunk."""
    return not rows.groupBy(CLIP).agg(F.min(chunk_of(order)).alias("a"), F.max(chunk_of(order)).alias("z")).filter("a < z").isEmpty()


def nearest(rows: DataFrame, value: Column, name: str, after: bool = False, own: bool = True, order: str = "frame", split: bool = True) -> DataFrame:
    """Adds ``name``: the ``value`` of the nearest row of the clip before (or ``after``) each row that has one, the
    row's own included unless ``own`` is false; null if there is none. ``value`` may be a struct, null where it doesn't count.

    Rows of one ``order`` in a clip are taken in any order. A null clip is a clip like any other. Without ``split`` no clip
    has a second chunk, as ``split_clips`` tells, so that nothing reaches over borders.
    """
    first = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    up_to = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    chunk = Window.partitionBy(*_OF).orderBy(first(order))
    at = _placed(rows, value, order)
    if not split:
        return at.select(*rows.columns, F.last("_value", True).over(up_to(chunk, 0 if own else -1)).alias(name))
    at = at.withColumns({"_inner": F.last("_value", True).over(up_to(chunk, 0 if own else -1)), "_edge": F.last("_value", True).over(up_to(chunk, Window.unboundedFollowing))})
    told = _told(at, F.last("_edge", True).over(up_to(Window.partitionBy("_key", "_none").orderBy(first("_chunk")), -1)))
    return at.join(told, _OF, "left").select(*rows.columns, F.coalesce("_inner", "_carried").alias(name))


def running_sum(rows: DataFrame, value: Column, name: str, order: str = "frame") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the clip's rows up to each row, all rows of its ``order`` included."""
    chunk = Window.partitionBy(*_OF).orderBy(order)
    at = _placed(rows, value, order)
    at = at.withColumns({"_inner": F.coalesce(F.sum("_value").over(chunk), F.lit(0)), "_edge": F.sum("_value").over(Window.partitionBy(*_OF))})
    told = _told(at, F.coalesce(F.sum("_edge").over(Window.partitionBy("_key", "_none").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(told, _OF, "left").select(*rows.columns, (F.col("_inner") + F.col("_carried")).alias(name))
