"""Ranked lexical search over dual-sorted wavelet trees (after Konow and Navarro, 2012).

A shard holds the postings of some documents as one sequence of document numbers: term after term, and of
a term by falling impact. The sequence is a wavelet tree over the numbers, so that each of its nodes is a
range of documents in which every term's postings are still together and by falling impact: the first of
them bounds what the term adds to any document of the node. A search goes down from the node with the
highest sum of bounds for all its terms at once; a leaf is a document with its exact score, and what is
bounded below the k-th best score is never entered. Levels have no pointers: each has its zeros first.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, new_path, small_side

#: A shard is closed when it has so many postings; a document isn't divided.
SHARD_POSTINGS = 1 << 20
#: Terms that a task sums before it hands them on; queries that a task holds at once; nodes that are entered together.
TALLY, QUERIES, NODES = 500_000, 256, 64
#: Parts in which the shards' best are ranked before all of a query's meet.
PARTS = 64
#: Scores are whole numbers in these units.
UNIT, TF_UNIT, M_UNIT, WEIGHT_UNIT, LENGTH_SHARE = 1_000_000_000, 1000, 12, 1000.0, 25

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
JAVA_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall(text.encode().translate(_LOWER)) if text else []


@dataclass
class Index:
    """``shards(file, at, shard)`` tell where each shard lies, ``dictionary(term, df)`` in how many documents a term is;
    ``n_docs`` documents have a term, ``n_terms`` in all."""

    shards: DataFrame
    dictionary: DataFrame
    n_docs: int
    n_terms: int
    id_type: T.DataType


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term; the row without a term has those with any, and the number of their terms."""
    held, docs, total = Counter(), 0, 0

    def out(terms: list, n: list, t: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["term", "df", "n_terms"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = terms_of(text)
            if found:
                docs, total = docs + 1, total + len(found)
                held.update(set(found))
        if len(held) > TALLY:
            yield out([*held], [*held.values()], [0] * len(held))
            held = Counter()
    yield out([*held, None], [*held.values(), docs], [0] * len(held) + [total])


class _Postings:
    """The postings of a shard while it is filled."""

    def __init__(self):
        self.ids, self.m, self.sizes, self.terms = [], [], [], {}
        self.term, self.tf = [], []

    def add(self, id_, m: int, counts: Counter) -> None:
        terms = self.terms
        self.term += [terms.setdefault(t, len(terms)) for t in counts]
        self.tf += counts.values()
        self.ids.append(id_)
        self.m.append(m)
        self.sizes.append(len(counts))

    def shard(self) -> dict:
        """Documents are numbered by their ids, null first; the sequence is by term, falling impact and number."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] if self.ids[i] is not None else 0))
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        doc, term, tf = np.repeat(number, self.sizes), np.array(self.term), np.array(self.tf, dtype=np.int64)
        impact = UNIT * tf // (TF_UNIT * tf + M_UNIT * np.repeat(np.array(self.m, dtype=np.int64), self.sizes))
        by = np.lexsort((doc, -impact, term))
        seq, levels, bits = doc[by].astype(np.int32), (len(order) - 1).bit_length(), []
        for h in range(levels):
            bit = ((seq >> (levels - 1 - h)) & 1).astype(bool)
            bits.append(np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64, dtype=bool)]), bitorder="little").tobytes())
            seq = np.concatenate([seq[~bit], seq[bit]])
        return {
            "ids": [self.ids[i] for i in order], "terms": [t.decode() for t in self.terms], "sizes": np.bincount(term, minlength=len(self.terms)).astype(np.int32).tobytes(),
            "impacts": impact[by].astype(np.int32).tobytes(), "bits": b"".join(bits), "levels": levels,
        }


def _shard_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.large_list(kind)), ("terms", pa.large_list(pa.large_string())), ("sizes", pa.large_binary()), ("impacts", pa.large_binary()), ("bits", pa.large_binary()), ("levels", pa.int32())])


def _write_shards(base: str, n_docs: int, n_terms: int):
    """Shards of the texts that a task reads, in one file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(base)
        path, schema, writer, stream, at, held = f"{root}/{uuid.uuid4().hex}.arrow", None, None, None, 0, _Postings()

        def flush() -> None:
            nonlocal writer, stream, at, held
            if held.ids:
                if writer is None:
                    files.create_dir(root, recursive=True)
                    stream = files.open_output_stream(path)
                    writer = pa.ipc.new_file(stream, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(pa.RecordBatch.from_pylist([held.shard()], schema))
                at, held = at + 1, _Postings()

        for batch in batches:
            schema = schema or _shard_schema(batch.schema.field("id").type)
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    held.add(id_, 100 - LENGTH_SHARE + LENGTH_SHARE * len(found) * n_docs // n_terms, Counter(found))
                    if len(held.term) >= SHARD_POSTINGS:
                        flush()
        flush()
        if writer is not None:
            writer.close()
            stream.close()
            first = TaskContext.get().partitionId() << 33
            yield pa.RecordBatch.from_arrays([pa.array([path] * at), pa.array(range(at), pa.int64()), pa.array([first + k for k in range(at)], pa.int64())], names=["file", "at", "shard"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every term of every document. Texts are read twice: for the statistics that impacts need, then for the
    shards, which are files of the shared folder. No document is moved."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_statistics, "term string, df bigint, n_terms bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_terms").alias("n_terms"))
    counted = Table(counted, "dictionary").df
    every = counted.filter("term IS NULL").agg(F.sum("df"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(v or 0) for v in every)
    shards = Table(rows.mapInArrow(_write_shards(new_path(docs.sparkSession, "index"), n_docs, n_terms), "file string, at bigint, shard bigint"), "shards").df
    return Index(shards, counted.filter("term IS NOT NULL").select("term", "df"), n_docs, n_terms, docs.schema[id_col].dataType)


class Shard:
    """A shard in memory: the impacts of every level, and its bits with the ones before each word of 64."""

    def __init__(self, row: pa.RecordBatch):
        got = {c: row.column(c)[0] for c in ("ids", "terms", "sizes", "impacts", "bits", "levels")}
        self.ids, self.terms, self.levels = got["ids"].values, got["terms"].values, got["levels"].as_py()
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(got["sizes"].as_buffer(), dtype=np.int32), dtype=np.int64)])
        impacts = np.frombuffer(got["impacts"].as_buffer(), dtype=np.int32)
        self.n = len(impacts)
        words = np.frombuffer(got["bits"].as_buffer(), dtype=np.uint64).reshape(self.levels, -(-self.n // 64))
        self.width = words.shape[1] + 1
        self.words = np.zeros((self.levels, self.width), dtype=np.uint64)
        self.words[:, :-1] = words
        self.before = np.zeros((self.levels, self.width), dtype=np.int64)
        np.cumsum(np.bitwise_count(words), axis=1, out=self.before[:, 1:])
        self.zeros = self.n - self.before[:, -1]
        self.impacts = np.empty((self.levels + 1, self.n), dtype=np.int32)
        self.impacts[0] = impacts
        for h in range(self.levels):
            bit = np.unpackbits(words[h].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            zeros = int(self.zeros[h])
            self.impacts[h + 1, :zeros], self.impacts[h + 1, zeros:] = self.impacts[h][~bit], self.impacts[h][bit]
        self.words, self.before, self.impacts = self.words.ravel(), self.before.ravel(), self.impacts.ravel()

    def _ones(self, level: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ones before a place of a level."""
        at = level * self.width + (place >> 6)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents, those of equal score in order; scores below ``floor`` are left out."""
        low, high, weight = self.ends[terms], self.ends[terms + 1], weights
        level, prefix, size = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.array([len(terms)])
        bound = np.array([(weight * self.impacts[low]).sum()])
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not self.levels:
            return (prefix, bound) if bound[0] >= floor else (docs, scores)
        while len(bound):
            now = np.zeros(len(bound), dtype=bool)
            now[np.argpartition(bound, -NODES)[-NODES:] if len(bound) > NODES else slice(None)] = True
            pairs = np.repeat(now, size)
            kept = (level[~now], prefix[~now], size[~now], bound[~now], low[~pairs], high[~pairs], weight[~pairs])
            l, r, w, n = low[pairs], high[pairs], weight[pairs], int(now.sum())
            owner = np.repeat(np.arange(n), size[now])
            h = level[now][owner]
            left, right = self._ones(h, l), self._ones(h, r)
            # Children by zeros, then those by ones; a term without postings in a child isn't carried on.
            l, r = np.concatenate([l - left, self.zeros[h] + left]), np.concatenate([r - right, self.zeros[h] + right])
            full = r > l
            child, l, r, w, h = np.concatenate([owner, owner + n])[full], l[full], r[full], np.concatenate([w, w])[full], np.concatenate([h, h])[full] + 1
            first = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1])))
            told = np.add.reduceat(w * self.impacts[h * self.n + l], first)
            node, count = child[first], np.diff(np.concatenate([first, [len(child)]]))
            depth, number = level[now][node % n] + 1, prefix[now][node % n] * 2 + (node >= n)
            leaf = depth == self.levels
            if leaf.any():
                docs, scores = np.concatenate([docs, number[leaf]]), np.concatenate([scores, told[leaf]])
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[top], scores[top]
                floor = max(floor, int(scores[-1])) if len(scores) == k else floor
            on = ~leaf & (told >= floor)
            pairs = np.repeat(on, count)
            stay = kept[3] >= floor
            held = np.repeat(stay, kept[2])
            level, prefix, size, bound = (np.concatenate([a[stay], b[on]]) for a, b in zip(kept[:4], (depth, number, count, told), strict=True))
            low, high, weight = (np.concatenate([a[held], b[pairs]]) for a, b in zip(kept[4:], (l, r, w), strict=True))
        good = scores >= floor
        return docs[good], scores[good]


def _search(path: str, k: int):
    """The k best documents of each shard for each query of the files in ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        asked = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
        floors: dict[int, int] = {}  # the k-th best score of a shard before: lower ones can't be among the best
        for batch in batches:
            for file, at, number in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "shard")), strict=True):
                with files.open_input_file(file) as stream:
                    shard = Shard(pa.ipc.open_file(stream).get_batch(at))
                for part in asked:
                    with files.open_input_file(part) as stream:
                        for queries in pq.ParquetFile(stream).iter_batches(QUERIES):
                            out = _answer(shard, queries, k, floors)
                            rows = sum(len(d) for _, d, _ in out)
                            if rows:
                                docs = np.concatenate([d for _, d, _ in out])
                                q = np.repeat([q for q, _, _ in out], [len(d) for _, d, _ in out])
                                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), shard.ids.take(pa.array(docs)), pa.array(np.concatenate([s for _, _, s in out])), pa.array(np.full(rows, number))], names=["q", "doc_id", "score", "shard"])

    return run


def _answer(shard: Shard, queries: pa.RecordBatch, k: int, floors: dict[int, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    terms, weights = queries.column("terms"), queries.column("weights").flatten().to_numpy()
    places = pc.fill_null(pc.index_in(terms.flatten().cast(pa.large_string()), value_set=shard.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts, out = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]), []
    for i, q in enumerate(queries.column("q").to_pylist()):
        place, weight = places[cuts[i] : cuts[i + 1]], weights[cuts[i] : cuts[i + 1]]
        if (place >= 0).any():
            docs, scores = shard.best(place[place >= 0], weight[place >= 0], k, floors.get(q, 1))
            if len(docs) == k:
                floors[q] = max(floors.get(q, 1), int(scores[-1]))
            out.append((q, docs, scores))
    return out


def weighted_queries(index: Index, items: DataFrame, id_col: str, text_col: str) -> Table:
    """``q`` (a row's own number), ``item_id``, and its ``terms`` with their ``weights``, repeats summed up."""
    told = Table(items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item_id"), F.translate(F.col(text_col).cast("string"), UPPER, LOWER).alias("text")), "items").df
    each = told.select("q", F.explode(F.regexp_extract_all("text", F.lit(JAVA_TERM), F.lit(0))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    known = index.dictionary.join(small_side(each.select("term").distinct()), "term", "left_semi")
    # In doubles, as the contract says.
    weight = F.floor(F.lit(WEIGHT_UNIT) * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    rows = each.join(known, "term").withColumn("w", weight * F.col("times")).filter("w > 0")
    return Table(rows.groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("x")).join(told.select("q", "item_id"), "q").select("q", "item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), "queries")


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents with a score above 0.

    Every shard is asked all queries, QUERIES at a time, from files of the shared folder.

    * Equal scores go by ascending doc_id, null first; documents that share an id are ranked each.
    * A null or empty text has no term: such a document is never found, such an item finds nothing.
    * Repeated items are answered each; a null item_id is an id like any other. Texts may have any length that a task
      can hold, and only the columns named are read.
    * An empty table of documents or items gives an empty result.
    """
    queries = weighted_queries(index, items, id_col, text_col)
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType()), T.StructField("shard", T.LongType())])
    n = index.shards.count()
    found = index.shards.repartition(max(1, min(n, 20_000))).mapInArrow(_search(queries.path, k), schema)
    best_first = [F.desc("score"), F.asc_nulls_first("doc_id")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))).filter(F.col("rank") <= k)
    some = ranked(found.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(PARTS))), "q", "part").drop("rank")
    return ranked(some, "q").join(queries.df.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
