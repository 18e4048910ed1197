"""Calibration files, stored homographies, label files and run options."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRESPONDENCES = "video string, frame bigint, correspondences array<struct<pixel: array<double>, pitch: array<double>, name: string>>"


@dataclass(frozen=True)
class Options:
    """What a run may set; the defaults are those of the operators."""

    max_coast_frames: int = 15
    process_noise: float = 5.0
    measurement_noise: float = 10.0
    person_confidence: float = 0.3
    ball_confidence: float = 0.1


def session_dir(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir; only a local session may have none set, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-tables"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this session's operators wrote, once no result that reads it is needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, for a small table that several joins use; its size is known to Spark,
    which broadcasts it only below its threshold. ``drop_scratch`` deletes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_options(spark: SparkSession, options: Options, path: str) -> None:
    """``key: value`` lines, a flat subset of YAML."""
    lines = [(f"{f.name}: {getattr(options, f.name)}",) for f in fields(options)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)


def read_options(spark: SparkSession, path: str) -> Options:
    """Options from ``key: value`` lines; comments, blank lines and other keys are passed over."""
    line = F.split(F.regexp_replace("value", r"\s*#.*$", ""), r"\s*:\s*", 2)
    rows = spark.read.text(path).select(F.trim(line[0]).alias("k"), F.trim(line[1]).alias("v")).filter(F.col("k").isin([f.name for f in fields(Options)]))
    return Options(**{r.k: type(getattr(Options, r.k))(r.v) for r in rows.limit(len(fields(Options))).collect()})


def read_all_options(spark: SparkSession, path: str) -> DataFrame:
    """One row a file below ``path``: ``job`` (its name without an ending) and every option, as given there or by default."""
    line = F.split(F.regexp_replace("value", r"\s*#.*$", ""), r"\s*:\s*", 2)
    rows = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"/([^/]+?)(?:\.[^/.]*)?$", 1).alias("job"), F.trim(F.get(line, F.lit(0))).alias("k"), F.trim(F.get(line, F.lit(1))).alias("v"))
    kinds = {int: "bigint", float: "double"}
    told = [F.coalesce(F.max(F.when(F.col("k") == f.name, F.col("v"))).cast(kinds[type(f.default)]), F.lit(f.default)).alias(f.name) for f in fields(Options)]
    return rows.groupBy("job").agg(*told)


#: Where a run's sectioned file has the options.
SECTIONED = {
    "ball_tracking.max_coast_frames": "max_coast_frames",
    "ball_tracking.process_noise": "process_noise",
    "ball_tracking.measurement_noise": "measurement_noise",
    "detection.confidence_threshold": "person_confidence",
    "detection.ball_confidence_threshold": "ball_confidence",
}


def _paths_of(text: Column) -> Column:
    """``array<struct<path, value>>`` of a text of sections: a key's path has the keys of the lines above that are indented less.

    Comments begin a line or follow white space; a line of a key without a value opens a section; lines without a colon
    have no key, and are passed over. Quotes around a value go.
    """
    bare = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(F.regexp_replace(x, r"(^|\s)\s*#.*$", ""))), lambda x: x.rlike(r":(\s|$)"))
    start = F.from_json(F.lit('{"above": [], "found": []}'), "above array<struct<indent: int, key: string>>, found array<struct<path: string, value: string>>")

    def step(s: Column, x: Column) -> Column:
        indent = F.length(F.regexp_extract(x, r"^(\s*)", 1))
        pair = F.split(F.regexp_replace(x, r"^\s+", ""), r"\s*:(?:\s+|$)", 2)
        above = F.concat(F.filter(s["above"], lambda a: a["indent"] < indent), F.array(F.struct(indent.alias("indent"), pair[0].alias("key"))))
        value = F.regexp_replace(pair[1], r"""^(["'])(.*)\1$""", "$2")
        own = F.array(F.struct(F.concat_ws(".", F.transform(above, lambda a: a["key"])).alias("path"), value.alias("value")))
        return F.struct(above.alias("above"), F.when(value == "", s["found"]).otherwise(F.concat(s["found"], own)).alias("found"))

    return F.aggregate(bare, start, step, lambda s: s["found"])


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """``(job, path, value)``: each value of each file of nested sections below ``path``, ``path`` with dots; an option file is one row."""
    texts = spark.read.text(path, wholetext=True)
    job = F.regexp_extract("_metadata.file_path", r"/([^/]+?)(?:\.[^/.]*)?$", 1).alias("job")
    return texts.select(job, F.explode(_paths_of(F.col("value"))).alias("p")).select("job", "p.*")


def read_sectioned_options(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of nested sections below ``path``: ``job`` and every option, as given in its section or by default.

    Values that aren't numbers (``null`` too) count as not given; of a path given twice, the last line's value holds. A file
    without a value has all defaults.
    """
    kinds, at = {int: "bigint", float: "double"}, {name: path for path, name in SECTIONED.items()}
    texts = spark.read.text(path, wholetext=True)
    job = F.regexp_extract("_metadata.file_path", r"/([^/]+?)(?:\.[^/.]*)?$", 1).alias("job")
    given = lambda name: F.try_element_at(F.filter("found", lambda p: p["path"] == at[name]), F.lit(-1))["value"]
    told = [F.coalesce(given(f.name).try_cast(kinds[type(f.default)]), F.lit(f.default)).alias(f.name) for f in fields(Options)]
    return texts.select(job, _paths_of(F.col("value")).alias("found")).select("job", *told)


def read_binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Uploads, anchor images or frames split from a video: ``name``, ``number`` (the last digits of the name), ``length``, ``content``.

    Files without bytes are passed over, as Spark's scans do.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("name"), F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("bigint").alias("number"), "length", "content")


def read_correspondences(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per pair of points: video, frame, name, pixel_x, pixel_y, pitch_x, pitch_y.

    A file holds one document over any number of lines or, with ``lines``, one on each line.
    """
    raw = spark.read.schema(CORRESPONDENCES).json(path, multiLine=not lines)
    each = raw.select("video", "frame", F.explode("correspondences").alias("c"))
    return each.select("video", "frame", "c.name", *(F.col(f"c.{s}")[i].alias(f"{s}_{a}") for s in ("pixel", "pitch") for i, a in enumerate("xy")))


def write_correspondences(pairs: DataFrame, path: str) -> None:
    """One JSON document per video and frame, each on a line; fewer than four pairs are refused."""
    pair = F.struct(F.array("pixel_x", "pixel_y").alias("pixel"), F.array("pitch_x", "pitch_y").alias("pitch"), "name")
    told = pairs.groupBy("video", "frame").agg(F.sort_array(F.collect_list(pair)).alias("correspondences"))
    if not told.filter(F.size("correspondences") < 4).isEmpty():
        raise ValueError("a calibration needs at least four pairs of points")
    told.write.mode("overwrite").json(path)


def save_homography(spark: SparkSession, h: np.ndarray, path: str) -> None:
    values = ", ".join(f"{float(v)!r}D AS h{i}" for i, v in enumerate(np.asarray(h).ravel()))
    spark.sql(f"SELECT {values}").coalesce(1).write.mode("overwrite").parquet(path)


def load_homography(spark: SparkSession, path: str) -> np.ndarray:
    row = spark.read.parquet(path).first()
    return np.array([row[f"h{i}"] for i in range(9)]).reshape(3, 3)


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """``split``, ``image`` and ``line`` of the files ``root/<split>/labels/<image>.txt``."""
    # The folders are listed: a pattern of files would make each file a path, with a task of its own to look at it.
    text = spark.read.option("pathGlobFilter", "*.txt").text(f"{root}/*/labels").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"))
    return text.filter("line <> ''").select(F.regexp_extract("f", r"/([^/]+)/labels/[^/]+$", 1).alias("split"), F.regexp_extract("f", r"/([^/]+)\.txt$", 1).alias("image"), "line")


def write_labels(labels: DataFrame, root: str, names: list[str]) -> str:
    """Label lines partitioned by split and image; returns the data set's description."""
    labels.select("split", "image", "line").repartition("split", "image").write.partitionBy("split", "image").mode("overwrite").text(f"{root}/labels")
    return json.dumps({"path": root, "train": "labels/split=train", "val": "labels/split=valid", "names": names})
