"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, so that an n-gram is a number below 256**n. Trusted text is counted in
full, each task summing before the shuffle, and the counts of every order stay sharded tables. Texts
are written as numbered blocks; the n-grams that a block holds are joined with the counts, their
contexts and ever shorter n-grams, and each block gets back the probabilities that it asked for. A
document's perplexity is compared with quantiles of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import numbered_blocks
from .common import Table, bounded_batches, new_path, small_side
from .shingles import byte_view, chunks

ORDER = 5
#: Bytes of a block's texts at most, but for a longer text; a task holds the distinct n-grams of one block.
BLOCK_BYTES = 16 << 20
#: Answers are written in row groups of so many bytes, so that one block of a folder can be read alone.
GROUP_BYTES = 8 << 20
#: Distinct n-grams that a task sums before it hands them on.
TALLY = 2_000_000
#: Of every FOLDS trusted documents, by a hash of the id, one isn't counted but sets the upper bound: a text that was counted scores too well.
FOLDS = 4
#: Quantiles of trusted perplexity within which a text is kept, and how far past the upper one it may go.
LOW, HIGH, SLACK = 0.001, 0.995, 1.1


#: Symbols are bytes as they are, so that no script and no way of writing is taken for another.
BASE, START = 256, 10


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the n-gram that ends at each byte, and the text of that byte; texts begin with line ends."""
    lens = np.diff(offs)
    pad = order - 1
    text = np.repeat(np.arange(len(lens)), lens)
    spread = np.full(len(data) + pad * len(lens), START, dtype=np.int64)
    place = np.arange(len(data)) + pad * (text + 1)
    spread[place] = data
    number = np.zeros(len(data), dtype=np.int64)
    for k in range(order):
        number = number * BASE + spread[place - (order - 1 - k)]
    return number, text


class _Tally:
    """Counts of n-grams, merged whenever the parts have grown."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, number: np.ndarray) -> None:
        if len(number):
            self.parts.append(np.unique(number, return_counts=True))
            self.size += len(self.parts[-1][0])
            if self.size > TALLY:
                self.merge()

    def merge(self) -> None:
        gram, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        self.parts, self.size = [(gram[first], np.add.reduceat(n, first))], len(first)

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            self.merge()
            (gram, n), self.parts, self.size = self.parts[0], [], 0
            for at in range(0, len(gram), 50_000):
                yield gram[at : at + 50_000], n[at : at + 50_000]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        out = lambda: (pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["gram", "n"]) for part in tally.take())
        for batch in batches:
            data, offs = byte_view(batch.column("text"))
            for a, b in chunks(offs):
                tally.add(grams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)[0])
            if tally.size > TALLY // 2:
                yield from out()
        yield from out()

    return run


@dataclass
class KneserNey:
    """Sharded tables of one order each: ``alphas[w](gram, alpha)`` is the discounted share of an n-gram
    among those of its context, ``gammas[w](context, gamma)`` the weight left to shorter n-grams."""

    order: int
    alphas: dict[int, DataFrame]
    gammas: dict[int, DataFrame]

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """``(gram, p)`` of the distinct n-grams of full order in ``wanted(gram)``, seen or not."""
        need = {self.order: wanted.select("gram").distinct()}
        for w in range(self.order - 1, 0, -1):
            need[w] = need[w + 1].select((F.col("gram") % BASE**w).alias("gram")).distinct()
        shorter = None
        for w in range(1, self.order + 1):
            rows = need[w].select("gram", F.expr(f"gram div {BASE}").alias("context"), (F.col("gram") % BASE ** (w - 1)).alias("suffix"))
            rows = rows.join(self.alphas[w], "gram", "left").join(self.gammas[w], "context", "left")
            if shorter is not None:
                rows = rows.join(shorter.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            below = F.lit(1 / BASE) if shorter is None else F.col("lower")
            p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below
            shorter = Table(rows.select("gram", p.alias("p")), "probabilities").df
        return shorter


def train_kneser_ney(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> KneserNey | None:
    """The model of the texts; None if they have no bytes.

    The full order uses counts, the others how many symbols an n-gram follows. Only the numbers of
    n-grams that occur once to four times come to the driver, for the discounts.
    """
    bounded_batches(trusted.sparkSession)
    texts = trusted.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    counts = Table(texts.mapInArrow(_count(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams").df
    if counts.isEmpty():
        return None
    alphas, gammas = {}, {}
    for w in range(order, 0, -1):
        seen = counts.agg(*(F.count_if(F.col("n") == k).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4))).first()
        y = seen["t1"] / (seen["t1"] + 2 * seen["t2"]) if seen["t1"] else 0.5
        discount = [min(0.95 * k, max(0.05, k - (k + 1) * y * seen[f"t{k + 1}"] / seen[f"t{k}"])) if seen[f"t{k}"] else 0.5 * k for k in (1, 2, 3)]
        d = F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2])
        rows = counts.select("gram", F.expr(f"gram div {BASE}").alias("context"), "n", d.alias("d"))
        totals = Table(rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("left")), "contexts").df
        alphas[w] = Table(rows.join(totals, "context").select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha")), "alphas").df
        gammas[w] = totals.select("context", (F.col("left") / F.col("total")).alias("gamma"))
        if w > 1:
            counts = Table(counts.groupBy((F.col("gram") % BASE ** (w - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams").df
    return KneserNey(order, alphas, gammas)


def _block_chunks(blocks: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of texts of one block, each of bounded size."""
    cuts = (np.flatnonzero(np.diff(blocks)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
        for c, d in chunks(offs[a : b + 1]):
            yield int(blocks[a]), a + c, a + d


def _asked(order: int):
    """The distinct n-grams of each block (again for each task that reads a part of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, now = _Tally(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for gram, _ in tally.take():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), now)), pa.array(gram)], names=["block", "gram"])

        for batch in batches:
            data, offs = byte_view(batch.column("text"))
            for block, a, b in _block_chunks(batch.column("block").to_numpy(), offs):
                if block != now:
                    yield from out()
                    now = block
                tally.add(grams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)[0])
        yield from out()

    return run


def _answers(files: fs.FileSystem, folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block, in order, and the logs of their probabilities."""
    paths = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    got = pa.concat_tables([pq.read_table(x, columns=["gram", "log"], filters=[("block", "=", block)], filesystem=files, partitioning=None) for x in paths])
    gram, log = got["gram"].to_numpy(), got["log"].to_numpy()
    order = np.argsort(gram, kind="stable")
    return gram[order], log[order]


def perplexities(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``lang``, ``n_bytes`` and ``perplexity`` (per byte; null without bytes) of each whole text.

    A block's n-grams are asked for once, however often its texts repeat them. No n-gram can be in more
    rows than there are blocks, so the join with the model has no hot keys.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = numbered_blocks(rows, "text", BLOCK_BYTES)
    asked = Table(blocks.select("block", "text").mapInArrow(_asked(model.order), "block long, gram long"), "asked").df
    answers = asked.join(model.probabilities(asked), "gram").select("block", "gram", F.ln("p").cast("float").alias("log"))
    base, order, buckets = new_path(spark, "answers"), model.order, int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).alias("bucket")
    dealt = answers.select(bucket, "*").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block", "gram")
    dealt.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(base)
        now, known, logs = None, None, None
        for batch in batches:
            data, offs = byte_view(batch.column("text"))
            lens, total = np.diff(offs), np.zeros(len(batch))
            folders = dict(zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), strict=True))
            for block, a, b in _block_chunks(batch.column("block").to_numpy(), offs):
                number, text = grams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)
                if not len(number):
                    continue
                if block != now:
                    now, (known, logs) = block, _answers(files, f"{root}/bucket={folders[block]}", block)
                at = np.minimum(np.searchsorted(known, number), len(known) - 1)
                if not np.array_equal(known[at], number):
                    raise ValueError(f"block {block} lacks probabilities of its n-grams")
                total[a:b] = np.bincount(text, weights=logs[at], minlength=b - a)
            perplexity = pa.array(np.exp(-total / np.maximum(lens, 1)), mask=lens == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(lens), perplexity], names=["doc_id", "lang", "n_bytes", "perplexity"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return blocks.select("*", bucket).mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``lang``, ``n_bytes``, ``perplexity``, the bounds ``low`` and ``high`` of its language, and ``kept``.

    Trusted documents are those with a label of quality 1 that isn't toxic. Three quarters of them are
    counted; the perplexities of the last quarter give the upper bound, those of all the lower one.

    * A null or empty text has no perplexity and isn't kept.
    * A null language, or one without trusted text of its own, is held to the bounds over all languages.
    * If one of the parts of the trusted documents has no text, all trusted documents serve as that part.
    * Repeated rows are scored alike and count as often as they occur; null labels and null ids are not trusted.
    * Without any trusted text nothing can be judged: perplexity and bounds are null and all texts with bytes are kept.
    * An empty table gives an empty result.
    """
    good = small_side(labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias(id_col)).distinct())
    counted = lambda c: F.pmod(F.xxhash64(c), F.lit(FOLDS)) > 0
    texts = docs.join(good, id_col, "left_semi")
    model = train_kneser_ney(texts.filter(counted(id_col)), text_col) or train_kneser_ney(texts, text_col)
    if model is None:
        n = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")
        none = F.lit(None).cast("double")
        return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), n.alias("n_bytes"), none.alias("perplexity"), none.alias("low"), none.alias("high"), (n > 0).alias("kept"))
    scored = Table(perplexities(docs, model, id_col, text_col, lang_col), "perplexities")
    trusted = scored.df.join(good.withColumnRenamed(id_col, "doc_id"), "doc_id", "left_semi")
    # Counted texts score lower than others: they may not set the upper bound, and the lower one must admit them.
    quantile = lambda q: F.percentile_approx("perplexity", q, 10_000)
    apart = trusted.filter(~counted("doc_id"))
    if apart.filter("perplexity IS NOT NULL").isEmpty():
        apart = trusted
    every = {"low": trusted.agg(quantile(LOW)).first()[0], "high": apart.agg(quantile(HIGH)).first()[0]}
    lows, highs = (df.filter("lang IS NOT NULL").groupBy("lang").agg(quantile(q).alias(n)) for df, q, n in ((trusted, LOW, "low"), (apart, HIGH, "high")))
    by_lang = lows.join(highs, "lang", "left")
    judged = scored.df.join(small_side(by_lang), "lang", "left")
    judged = judged.withColumns({"low": F.coalesce(F.col("low"), F.lit(every["low"])), "high": F.coalesce(F.col("high"), F.lit(every["high"])) * SLACK})
    kept = F.coalesce((F.col("perplexity") >= F.col("low") / SLACK) & (F.col("perplexity") <= F.col("high")), F.lit(False))
    return judged.select("doc_id", "lang", "n_bytes", "perplexity", "low", "high", kept.alias("kept"))
