"""What the operators share: durable scratch tables, Arrow batch size, size-checked joins."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast, with 16 for each value and its length for each text; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Keys whose rows are joined where they are, those with the most rows, if they have over HOT_ROWS of them;
#: no other key has over 1 / HOT_KEYS of all rows.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Python workers get Arrow batches of so many rows at most, so that long texts can't fill a worker.

    The plan is made when its result is asked for, so the session keeps the bound; a lower one of its own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` is ``value`` for the plans made inside; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir. Only a local session may have none; it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-llm-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Folders that what is written goes to, the innermost last; none is the session's own. Each thread has its own.
_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())
#: Folders of stages whose results may not have been read yet, by session and thread.
_pending: dict[tuple[str, int], list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folders.get()[-1] if _folders.get() else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as it takes to be none of ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _inside(folder: str) -> Iterator[None]:
    before = _folders.set((*_folders.get(), folder))
    try:
        yield
    finally:
        _folders.reset(before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, but for tables whose path was made outside."""
    folder = new_path(spark, "scratch")
    try:
        with _inside(folder):
            yield
    finally:
        delete(spark, folder)


def _owner(spark: SparkSession) -> tuple[str, int]:
    return spark.sparkContext.applicationId, threading.get_ident()


@contextmanager
def stage(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """What is written inside goes to a folder of the stage.

    It begins by deleting what stages before it, in this thread, wrote for themselves, unless ``docs`` still reads that: stages
    may be chained without writing their results. If it fails, what it wrote is deleted; what others write is never touched.
    """
    mine, folder = _owner(spark), f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    waiting = _pending.pop(mine, [])
    if waiting:
        read_now = docs.inputFiles()
        kept = waiting if any(w.split("/")[-1] in f for w in waiting for f in read_now) else []
        for w in set(waiting) - set(kept):
            delete(spark, w)
        waiting = kept
    try:
        with _inside(folder):
            yield
    except BaseException:
        delete(spark, folder)
        _pending[mine] = waiting
        raise
    _pending[mine] = [*waiting, folder]


def end_stages(spark: SparkSession) -> None:
    """What the last stages wrote for themselves stays, as results may read it, until ``drop_scratch``."""
    _pending.pop(_owner(spark), None)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this session wrote to the shared folder, once no result that reads it is needed."""
    delete(spark, shared_dir(spark))


class Table:
    """A DataFrame written as Parquet to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, level: int = 3, path: str | None = None, by: str | None = None):
        self.spark, self.path = df.sparkSession, path or new_path(df.sparkSession, name)
        out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
        (out.partitionBy(by) if by else out).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def bytes_of(df: DataFrame):
    """About the bytes of all rows, as an aggregate."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return F.coalesce(F.sum(sum(texts, F.lit(16 * len(df.columns))).cast("bigint")), F.lit(0))


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df``, of numbers and texts, if it has at most ``most`` bytes, else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(most // 16 + 1).agg(bytes_of(df)).first()[0] <= most else df


def join_counted(rows: DataFrame, side: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key and in ``count`` how many rows the key has in ``rows``.

    The HOT_KEYS keys with the most rows, of those with over HOT_ROWS, are broadcast, so that the rows of
    a hot key stay in their tasks; all others are dealt by key, small tables too: one plan for every size. ``how`` is inner, left or left_semi. ``count`` isn't returned.
    ``rows`` and ``side`` are read twice.
    """
    plain = side.drop(count)
    hot = Table(side.filter(F.col(count) > HOT_ROWS).orderBy(F.desc(count), *key).limit(HOT_KEYS).drop(count), "hot-keys").df
    if hot.isEmpty():
        return rows.join(plain.hint("merge"), key, how)
    names = F.broadcast(hot.select(*key))
    rest = rows.join(names, key, "left_anti").join(plain.join(names, key, "left_anti").hint("merge"), key, how)
    return rows.join(F.broadcast(hot), key, "inner" if how == "left" else how).unionByName(rest)


def join_salted(rows: DataFrame, side: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """As ``join_counted`` (inner or left), for a ``side`` of wide rows: nothing of it is broadcast but the keys of the hot ones.

    A hot key's row of ``side`` is repeated once for each HOT_ROWS rows of the key, and these are dealt among the copies.
    """
    hot = Table(side.filter(F.col(count) > HOT_ROWS).select(*key, count).orderBy(F.desc(count), *key).limit(HOT_KEYS), "hot-keys").df
    plain = side.drop(count)
    if hot.isEmpty():
        return rows.join(plain.hint("merge"), key, how)
    salt, parts = free_name([*rows.columns, *side.columns], "salt"), F.expr(f"`{count}` div {HOT_ROWS}") + 1
    known = F.broadcast(hot)
    dealt = rows.join(known, key).withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)).drop(count)
    copies = plain.join(known, key).withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop(count)
    rest = rows.join(known.select(*key), key, "left_anti").join(plain.join(known.select(*key), key, "left_anti").hint("merge"), key, how)
    return dealt.join(copies.hint("merge"), [*key, salt]).drop(salt).unionByName(rest)


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``ids``; rows with a null key stay."""
    return docs.join(small_side(ids.select(key).distinct()), key, "left_anti")
