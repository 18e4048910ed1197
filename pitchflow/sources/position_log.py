"""Position-log sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.schema import BALL, PERSON, POSITION_LOG, REF
from pitchflow.sources.files import stored


#: Columns of a CSV log, in order; the clip comes from the folder or the caller.
CSV = "frame bigint, track_id bigint, class_name string, team double, pixel_x double, pixel_y double, pitch_x double, pitch_y double, bbox_height double, is_predicted boolean, clip_id string"


def numbered(raw: DataFrame, name: str, by: str) -> DataFrame:
    """Adds ``name``: the number, from 0, of each row of a scanned text table among those of its ``by``, in the order of its files.

    Spark packs files into tasks by size, so the order of a scan isn't that of the files. But rows of one block of
    a file come in order. So blocks are counted first, one row each, summed up by file and place; then each row
    has its place in its block and the rows before the block. No row is moved or sorted for it. Files are in order of their
    part numbers, then their names.
    """
    at = raw.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    part = F.coalesce(F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint"), F.lit(0))
    blocks = stored(at.groupBy(by, "_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("_part", part), "blocks")
    within = Window.partitionBy(by, "_part", "_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy(by, "_part", "_file").agg(F.sum("_n").alias("_n"))
    before = files.withColumn("_files", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a file
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(before.select(by, "_file", "_files"), [by, "_file"])
    told = stored(blocks.select("_file", "_start", "_first", "_n", (F.col("_before") + F.col("_files")).alias("_before")), "block-places")
    place = F.col("_id") - F.col("_first")
    # Both scans must be packed alike, which Spark does for the same files and settings.
    moved = F.raise_error(F.concat(F.lit("files changed while they were read: "), "_file")).cast("bigint")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place).otherwise(moved)
    return at.join(told, ["_file", "_start"]).withColumn(name, number).drop("_file", "_start", "_id", "_first", "_n", "_before")


def read_csv(spark: SparkSession, path: str, clip_id: str = "clip") -> DataFrame:
    """A log written as CSV; NaN becomes null once, here, and ``log_seq`` is a row's number in its clip in the order of the files.

    With folders ``clip_id=...`` each is a clip, else all files are the clip ``clip_id``.
    """
    raw = spark.read.schema(CSV).option("header", True).csv(path).withColumn("clip_id", F.coalesce("clip_id", F.lit(clip_id)))
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("team", "pitch_x", "pitch_y", "bbox_height")}
    rows = numbered(raw, "log_seq", "clip_id").withColumns(clean).withColumn("team", F.col("team").cast("int"))
    return rows.select(POSITION_LOG.names)


def write_csv(log: DataFrame, path: str, by_clip: bool = False) -> None:
    """Parts in order of ``log_seq``: a folder for all or, ``by_clip``, one for each clip."""
    columns = [*(c for c in POSITION_LOG.names if c not in ("clip_id", "log_seq")), *(["clip_id"] if by_clip else [])]
    ordered = log.repartitionByRange(*(["clip_id"] if by_clip else []), "log_seq").sortWithinPartitions(*(["clip_id"] if by_clip else []), "log_seq").select(*columns)
    out = ordered.write.option("header", True).mode("overwrite")
    (out.partitionBy("clip_id") if by_clip else out).csv(path)


def write_parquet(log: DataFrame, path: str) -> None:
    log.write.partitionBy("clip_id").mode("overwrite").parquet(path)


def in_clips(log: DataFrame, frames: int) -> DataFrame:
    """The log cut in clips of so many frames, each numbered from 0."""
    return log.withColumns({"clip_id": F.concat(F.lit("clip"), F.expr(f"frame div {frames}").cast("string")), "frame": F.col("frame") % frames})


def uncalibrated(log: DataFrame) -> DataFrame:
    """The log as it is without a calibration: no pitch positions."""
    return log.withColumns({c: F.lit(None).cast("double") for c in ("pitch_x", "pitch_y")})


def from_events(events: DataFrame, clip_id: str = "clip") -> DataFrame:
    """A deterministic log from the events table: 24 slots a frame, in integer centimetres until the last step."""
    e = events.select(
        F.col("event_id").alias("log_seq"), F.expr("event_id div 24").alias("frame"), (F.col("event_id") % 24).alias("slot"), "user_id", F.round(F.col("value") * 100).cast("bigint").alias("v")
    )
    e = e.withColumns({"jx": F.expr("v % 401 - 200"), "jy": F.expr("(user_id * 37 + v) % 401 - 200"), "carrier": F.expr("1 + ((frame div 5) * 7) % 22")})
    e = e.withColumn("s", F.when(F.col("slot") == 0, F.col("carrier")).otherwise(F.col("slot"))).withColumn("k", F.col("s") % 11)
    depth = F.expr("CASE WHEN k = 1 THEN 500 WHEN k BETWEEN 2 AND 5 THEN 2000 WHEN k BETWEEN 6 AND 9 THEN 4500 ELSE 7000 END")
    bx = F.when(F.col("s") >= 12, 10500 - depth).otherwise(depth)
    by = F.expr("CASE WHEN k = 1 THEN 3400 WHEN k BETWEEN 2 AND 9 THEN 1000 + 1600 * ((k - 2) % 4) ELSE 2500 + 1800 * (k div 10) END")
    ball, ref = F.col("slot") == 0, F.col("slot") == 23
    e = e.filter("NOT (slot = 0 AND (frame % 40 BETWEEN 20 AND 33 OR frame % 13 = 5))")
    x = F.when(ref, 5250 + F.col("jx")).when(ball, bx + F.expr("jx div 2") + F.when(F.col("frame") % 29 == 11, 30000).otherwise(0)).otherwise(bx + F.col("jx"))
    y = F.when(ref, 3400 + F.col("jy")).when(ball, by + F.expr("jy div 2")).otherwise(by + F.col("jy"))
    track = F.when(ball, F.lit(-1)).when(F.col("slot") % 7 == 3, F.expr("slot + 100 * (frame div 100)")).otherwise(F.col("slot"))
    # A filter on a position would be moved below it, with the whole expression for each bound: a generator's columns are made once.
    e = e.withColumns({"ball": ball, "ref": ref}).select("*", F.inline(F.array(F.struct(x.alias("x"), y.alias("y")))))
    x, y, ball, ref = map(F.col, ("x", "y", "ball", "ref"))
    return e.select(
        F.lit(clip_id).alias("clip_id"), "log_seq", "frame", track.cast("bigint").alias("track_id"),
        F.when(ball, BALL).when(ref, REF).otherwise(PERSON).alias("class_name"),
        F.when(F.col("slot").between(1, 11), 0).when(F.col("slot").between(12, 22), 1).alias("team"),
        (x / 10.0).alias("pixel_x"), (y / 10.0).alias("pixel_y"), (x / 100.0).alias("pitch_x"), (y / 100.0).alias("pitch_y"),
        (60 + F.col("v") % 61).cast("double").alias("bbox_height"), F.lit(False).alias("is_predicted"),
    )
