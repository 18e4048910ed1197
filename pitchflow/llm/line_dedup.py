"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hash, number of documents), bucketed and sorted by hash, so that it is joined
bucket by bucket as it lies. A batch of documents merge-anti-joins the runs' "settled" lines, those
that have reached the threshold (the commonest lines, most of the rows, aren't written again and again), and
adds what is left as one run at level 0; when a level has ``FANOUT`` runs they are merged into one run of the
next level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, bounded_batches, delete, join_counted, join_salted, new_path, session_setting
from .url_filter import blocked_bloom, may_hold

#: Runs of a level that are merged; batches in which a corpus is added.
FANOUT, BATCHES = 4, 5
#: Spark uses the order of a bucketed table's files only with this setting.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: str | None) -> list[bytes]:
    """Key of each line: stripped of [\\x20\\x09-\\x0D], A-Z as a-z; b"" if the line is blank."""
    return [x.strip(_SPACES) for x in (text or "").encode().translate(_LOWER).split(b"\n")]


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _document_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [_digest(k) for k in set(line_keys(text)) if k and len(k.decode()) >= min_chars]
                rows += [i] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int32())), pa.array(hashes, pa.binary())], names=["doc", "hash"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes out the lines whose keys are in ``drop``."""
    for batch in batches:
        texts, n, dropped = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            kept = lines
            if drop:
                out = set(drop)
                kept = [x for x, k in zip(lines, line_keys(text), strict=True) if not k or _digest(k) not in out]
            n.append(len(lines))
            dropped.append(len(lines) - len(kept))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["id", "text", "n_lines", "n_dropped"])


class Run:
    """A table of (hash, n) in as many buckets as the session has shuffle partitions, each one file sorted by hash.

    ``dealt`` rows are so already: a task has those of one bucket, in order.
    """

    def __init__(self, spark: SparkSession, counts: DataFrame, buckets: int, dealt: bool = False):
        self.spark, self.path, self.name = spark, new_path(spark, "run"), f"line_run_{uuid.uuid4().hex}"
        counts = counts.select("hash", "n")
        dealt = counts if dealt else counts.repartition(buckets, "hash")
        dealt.write.bucketBy(buckets, "hash").sortBy("hash").option("path", self.path).option("compression", "zstd").format("parquet").saveAsTable(self.name)
        self.df = spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


class LineRuns:
    """The levelled runs. ``threshold`` is the number of documents at which a line is settled."""

    def __init__(self, spark: SparkSession, threshold: int):
        self.spark, self.threshold, self.levels = spark, threshold, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _all(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[Run]) -> DataFrame:
        # Read as plain files: grouped without a shuffle, a union of bucketed scans doesn't meet all rows of a hash (Spark 4.1.2).
        return self.spark.read.schema("hash binary, n bigint").parquet(*(run.path for run in runs)).groupBy("hash").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame | None:
        """``(hash, n)`` of the settled lines; n grows with a line's documents, though it isn't kept up once settled."""
        return self._merged(self._all()).filter(F.col("n") >= self.threshold) if self._all() else None

    def _compacted(self, runs: list[Run]) -> Run:
        """One run of several: two at a time are merged bucket by bucket as they lie, without a shuffle."""
        while len(runs) > 1:
            merged = []
            for a, b in zip(runs[::2], runs[1::2], strict=False):
                n = F.coalesce(a.df["n"], F.lit(0)) + F.coalesce(b.df["n"], F.lit(0))
                both = a.df.hint("merge").join(b.df, a.df["hash"] == b.df["hash"], "full")
                merged.append(Run(self.spark, both.select(F.coalesce(a.df["hash"], b.df["hash"]).alias("hash"), n.alias("n")), self.buckets, dealt=True))
                a.drop()
                b.drop()
            runs = merged + runs[len(merged) * 2 :]
        return runs[0]

    def unseen(self, counts: DataFrame, least: int = 1) -> DataFrame:
        """The rows of ``counts(hash, n)`` whose hash no run has with a count of at least ``least``."""
        return reduce(lambda df, run: df.join(run.df.filter(F.col("n") >= least).hint("merge"), "hash", "left_anti"), self._all(), counts)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of ``(hash)``, one row for each document that holds the line."""
        counts = lines.groupBy("hash").agg(F.count("*").alias("n"))
        with session_setting(self.spark, ORDERED, "true"):
            self.levels[0].append(Run(self.spark, self.unseen(counts, self.threshold), self.buckets))
            for k, level in enumerate(self.levels):
                if len(level) < FANOUT:
                    break
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k] = []
                self.levels[k + 1].append(self._compacted(level))

    def drop(self) -> None:
        for run in self._all():
            run.drop()
        self.levels = [[]]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """Takes lines found in at least ``min_documents`` documents out of every document.

    Returns ``doc_id``, ``text`` (the lines left, joined by \\n), ``n_lines`` (before) and ``n_dropped``,
    one row per input row. Only ``id_col`` and ``text_col`` are read. The corpus is added in ``batches`` parts by
    a hash: a larger number keeps the parts small, the result doesn't depend on it.

    * A null or empty text is one empty line, and the text returned is empty.
    * Lines with keys under ``min_chars`` code points are never dropped.
    * Every row is a document: repeated rows count, and come back, as often as they occur, and a null
      id is an id like any other.
    * A text may have any length; its distinct lines must fit in a task.
    * An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Documents that share a key by chance do no harm: a line that is frequent is taken out of each that has it.
    texts = texts.withColumn("doc", F.xxhash64("id", "text"))
    found = texts.mapInArrow(_document_lines(min_chars), "doc bigint, hash binary").withColumn("batch", F.pmod("doc", F.lit(batches)))
    lines = Table(found, "lines", by="batch").df  # a batch reads its own files

    runs = LineRuns(spark, min_documents)
    try:
        for k in range(batches):
            runs.add(lines.filter(F.col("batch") == k).select("hash"))
        frequent = Table(runs.frequent(), "frequent").df
    finally:
        runs.drop()
    # A document's rows are as many as there are of each of its lines.
    drops = join_counted(lines.select("doc", "hash"), frequent, ["hash"], "n", "left_semi").groupBy("doc").agg(F.collect_set("hash").alias("drop"), F.count("*").alias("n"))
    drops = Table(drops.withColumn("n", F.expr("n div size(drop)")), "drops").df
    bloom, blocks = blocked_bloom(drops.select(F.col("doc").alias("key")), max(1, drops.count()))
    touched = may_hold(bloom.scalar(), blocks, F.col("doc"))
    moved = join_salted(texts.filter(touched), drops, ["doc"], "n", "left")
    stay = texts.filter(~touched).withColumn("drop", F.lit(None).cast("array<binary>"))  # not shuffled
    both = moved.unionByName(stay).select("id", "text", "drop")
    kind = texts.schema["id"].dataType.simpleString()
    return both.mapInArrow(_without, f"id {kind}, text string, n_lines bigint, n_dropped bigint").withColumnRenamed("id", "doc_id")
