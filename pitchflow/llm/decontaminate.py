"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, and is split into k + 1 pieces, has a piece
that occurs exactly. All pieces are found in one pass over the text by an Aho-Corasick automaton, and
each place that a hit suggests is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, bounded_batches

#: Edits allowed for each 100 characters of an item.
EDITS_PER_100 = 8
#: Items go to the executors in slices of about so many characters, so that a worker's automaton is bounded.
SLICE_CHARS = 2 << 20


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces that cover the item, with their places."""
    cuts = [round(i * len(item) / (edits + 1)) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def best_match(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Fewest edits between ``item`` and any part of ``text``, and where that part ends (Myers 1999)."""
    if masks is None:
        masks = letter_masks(item)
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best, end = score, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(xh | up)), up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, at
        plus, minus = plus << 1, minus << 1
        up, down = (minus & full) | (full & ~(xv | plus)), plus & xv & full
    return best, end


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


class Matcher:
    """Finds the items of one slice in texts."""

    def __init__(self, items: list[str], edits_per_100: int):
        self.items = [normalise(x) for x in items]
        self.edits = [len(x) * edits_per_100 // 100 for x in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (item, edits) in enumerate(zip(self.items, self.edits, strict=True)):
            for at, piece in pieces(item, edits) if item else []:
                places[piece].append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item number, edits, end) of each item that is in the text with few enough edits."""
        text, starts = normalise(text), defaultdict(list)
        if not text or not len(self.automaton):
            return []
        for end, where in self.automaton.iter(text):
            for k, at in where:
                starts[k].append(end + 1 - at)
        out = []
        for k, found in starts.items():
            item, edits = self.items[k], self.edits[k]
            if (at := text.find(item)) >= 0:
                out.append((k, 0, at + len(item)))
                continue
            found.sort()
            best, at = (edits + 1, 0), 0
            while at < len(found):  # places within reach of one another are verified as one window
                to = at
                while to + 1 < len(found) and found[to + 1] - found[to] <= 2 * edits:
                    to += 1
                a = max(0, found[at] - edits)
                if k not in self.masks:
                    self.masks[k] = letter_masks(item)
                got, end = best_match(item, text[a : found[to] + len(item) + edits], self.masks[k])
                best, at = min(best, (got, a + end)), to + 1
            if best[0] <= edits:
                out.append((k, *best))
        return out


#: The matcher that this Python worker built last, and for which slice.
_held: list = [None, None]


def _matcher(shared, name: str, edits_per_100: int) -> Matcher:
    """The slice's matcher, built once in each Python worker and not in each task."""
    if _held[0] != name:
        _held[:] = name, Matcher([text for _, text in shared.value], edits_per_100)
    return _held[1]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_per_100: int = EDITS_PER_100) -> DataFrame:
    """Which test items each document holds, whole, with at most ``edits_per_100`` percent of edits.

    Returns ``doc_id``, ``item_id``, ``edits`` (fewest found) and ``end`` (where the match ends in the
    text in lower case with single spaces): one row per document row and item.

    * Null, empty or blank texts and items match nothing. Items with a null id are matched too.
    * A text may have any length. Other columns than the two named aren't read.
    * Repeated documents and repeated items each give their own rows.
    * Empty tables give an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([texts.schema["doc_id"], benchmark.schema["item_id"], T.StructField("edits", T.IntegerType()), T.StructField("end", T.LongType())])
    found = None
    for rows, last in _slices(benchmark):
        shared = spark.sparkContext.broadcast(rows)
        part = texts.mapInArrow(_search(shared, edits_per_100, schema), schema)
        if not last:  # one slice's items and automata at a time
            part = Table(part, "found").df
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def _slices(benchmark: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """Ids and texts of the test items in slices of about SLICE_CHARS characters, and whether it is the last; one empty slice if there are none."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    n = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // SLICE_CHARS
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], k + 1 == n


def _search(shared, edits_per_100: int, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds, name = [to_arrow_type(schema[c].dataType) for c in ("doc_id", "item_id")], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, matcher = shared.value, _matcher(shared, name, edits_per_100)
        for batch in batches:
            rows = [(i, *m) for i, text in enumerate(batch.column("text").to_pylist()) for m in matcher.find(text)]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kinds[0]).take(at), pa.array([items[r[1]][0] for r in rows], kinds[1]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=schema.names)

    return run


def _clean(shared, edits_per_100: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, name, edits_per_100)
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([not matcher.find(text) for text in texts], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a test item. Each row is judged by its own text, whatever its id.

    All columns come back, whatever their names; null and empty texts, and every row if there are no items, stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    for rows, last in _slices(benchmark):
        shared = spark.sparkContext.broadcast(rows)
        docs = docs.mapInArrow(_clean(shared, EDITS_PER_100), docs.schema)
        if not last:  # one slice's items and automata at a time
            docs = Table(docs, "clean").df
            shared.unpersist()
    return docs
