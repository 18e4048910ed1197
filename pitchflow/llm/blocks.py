"""Texts in numbered blocks that a task can ask something for and get the answers of.

A block is bounded by bytes and rows, so what is asked for it is too. Answers are files of the shared
folder, sorted by block, and a task that goes through a block's texts loads those of that block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, new_path
from .shingles import byte_view

#: Most bytes and rows of a block; a longer text is one alone.
BLOCK_BYTES, BLOCK_ROWS = 24 << 20, 1 << 14
#: Answers are written in row groups of so many bytes, so that one block of a folder can be read alone.
GROUP_BYTES = 8 << 20


def _numbered(at: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, rows = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            out = np.empty(len(batch), dtype=np.int64)
            for i, length in enumerate(np.diff(byte_view(batch.column(at))[1]).tolist()):
                if rows and (size + length > most or rows >= BLOCK_ROWS):
                    block, size, rows = block + 1, 0, 0
                size, rows = size + length, rows + 1
                out[i] = block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    return run


def numbered_blocks(rows: DataFrame, text_col: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` and their ``block``, written, so that a block keeps its rows whichever task reads them."""
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
    return Table(rows.mapInArrow(_numbered(rows.columns.index(text_col), most), schema), "blocks").df


class Answers:
    """Rows with a ``block``, in as many folders as the session has shuffle partitions."""

    def __init__(self, rows: DataFrame, by: str):
        spark = rows.sparkSession
        self.path, self.columns = new_path(spark, "answers"), [c for c in rows.columns if c != "block"]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(self.bucket, "*").repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "block", by)
        dealt.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(self.path)

    @property
    def bucket(self):
        return F.pmod(F.xxhash64("block"), F.lit(self.buckets)).alias("bucket")


def answers_of(files: fs.FileSystem, folder: str, block: int, columns: list[str]) -> pa.Table:
    paths = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(x, columns=columns, filters=[("block", "=", block)], filesystem=files, partitioning=None) for x in paths])
