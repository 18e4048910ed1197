"""Progress of jobs that run as streams, and streams over tables that are handed over part by part."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from pitchflow.sources.files import scratch


class JobProgress(StreamingQueryListener):
    """Turns the batches of named streaming queries into fractions of their jobs, between ``low`` and ``high``.

    ``expect`` tells how many rows a job has; ``fraction`` how far it is, None before its first batch; ``told`` is
    called with the name and the fraction at each batch, and with ``high`` or the error when the query ends.
    """

    def __init__(self, low: float = 0.05, high: float = 0.7, told: Callable[[str, float | None, str | None], None] | None = None):
        self.low, self.high, self.told = low, high, told or (lambda *_: None)
        self.expected: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.names: dict[str, str] = {}
        self.errors: dict[str, str] = {}

    def expect(self, name: str, rows: int) -> None:
        self.expected[name] = rows

    def fraction(self, name: str) -> float | None:
        if name not in self.rows or name not in self.expected:
            return None
        share = min(1.0, self.rows[name] / self.expected[name]) if self.expected[name] else 1.0
        return round(self.low + share * (self.high - self.low), 6)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        name = event.progress.name
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.told(name, self.fraction(name), None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.id), None)
        if name is None:
            return
        if event.exception:
            self.errors[name] = event.exception
        self.told(name, None if event.exception else self.high, event.exception)


@contextmanager
def listening(spark: SparkSession, listener: StreamingQueryListener):
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def in_parts(rows: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str, once: bool = False) -> DataFrame:
    """What a stream over ``rows``, handed over one after the other, appends. After each part the query ends, and the
    next one takes up its state from the checkpoint, as after a lost driver.

    State that expires by the clock needs ``once``, one batch a part: else its query never runs out of work.
    """
    spark = rows[0].sparkSession
    base = scratch(spark, name)
    source, sink, kept = (f"{base}/{x}" for x in ("in", "out", "checkpoint"))
    schema = None
    for k, part in enumerate(rows):
        part.write.mode("append").parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(part.schema).parquet(f"{source}/*")
        made = transform(stream)
        schema = made.schema
        made.writeStream.format("parquet").queryName(name).option("checkpointLocation", kept).option("path", sink).outputMode("append").trigger(**({"once": True} if once else {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(schema).parquet(sink)
