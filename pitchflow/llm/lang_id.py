"""Language identification by a byte convolutional network.

The network reads fixed windows of bytes: filters of several widths slide over one-hot bytes, each
filter is max-pooled over the window, and a softmax layer gives the language. It is trained in numpy
on windows of labelled texts. To predict, every text is cut into windows from end to end, and the
windows' log-probabilities are averaged by their number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .shingles import byte_view, chunks

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The training sample: about so many documents of each language, so many windows of each.
DOCS_PER_LANG, WINDOWS_PER_DOC = 240, 6
#: The sample comes to the driver (about 370 kB a language), so that more languages than this are an error.
MAX_LANGS = 1000
EPOCHS, BATCH, RATE = 10, 128, 0.01
UNDETERMINED = "und"
#: Bytes of text that go through the filters at once.
SLICE_BYTES = 1 << 16


@dataclass
class ByteConvNet:
    langs: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    _pairs: list = field(default_factory=list, repr=False)

    @classmethod
    def untrained(cls, langs: list[str], rng: np.random.Generator) -> ByteConvNet:
        n = len(WIDTHS) * FILTERS
        tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(langs, tables, np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.dense_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the cross-entropy, summed by ``weight``, for each of the parameters. ``x`` has one window a row."""
        rows, pooled, where = np.arange(len(x)), [], []
        for table in self.tables:
            w = len(table)
            conv = sum(table[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            where.append(conv.argmax(axis=1))
            pooled.append(np.take_along_axis(conv, where[-1][:, None], 1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ self.dense + self.dense_bias)
        p[rows, y] -= 1
        p *= weight[:, None]
        back, out = (p @ self.dense.T) * (raw > 0), []
        for k, table in enumerate(self.tables):
            g, part = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(table)):
                np.add.at(g[j], (x[rows[:, None], where[k] + j], np.arange(FILTERS)), part)
            out.append(g)
        return [*out, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    @classmethod
    def train(cls, windows: np.ndarray, labels: list[str], seed: int = 7) -> ByteConvNet:
        """Adam on the cross-entropy, languages weighing alike. ``windows`` has one row of WINDOW bytes for each label."""
        rng, langs = np.random.default_rng(seed), sorted(set(labels))
        number = {x: i for i, x in enumerate(langs)}
        y = np.array([number[x] for x in labels])
        net = cls.untrained(langs, rng)
        params = net.parameters()
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        share = 1 / np.bincount(y, minlength=len(langs))[y]
        share *= len(y) / share.sum()
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows, step = order[at : at + BATCH], step + 1
                for param, grad, (m, v) in zip(params, net.gradients(windows[rows], y[rows], share[rows] / len(rows)), moments, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return net

    def window_scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows; two neighbouring bytes are looked up together."""
        if not self._pairs:
            for t in self.tables:
                self._pairs.append([(t[j][:, None] + t[j + 1][None]).reshape(1 << 16, -1) for j in range(0, len(t) - 1, 2)])
        two = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
        pooled = []
        for t, pairs in zip(self.tables, self._pairs, strict=True):
            w, conv = len(t), None
            end = WINDOW - w + 1
            for k, pair in enumerate(pairs):
                got = pair[two[:, 2 * k : 2 * k + end]]
                conv = got if conv is None else np.add(conv, got, out=conv)
            if w % 2:
                conv += t[w - 1][x[:, w - 1 : w - 1 + end]]
            pooled.append(conv.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return np.log(_softmax(hidden @ self.dense + self.dense_bias) + 1e-12)

    def text_scores(self, column: pa.Array) -> np.ndarray:
        """Probabilities of the languages for each text of a string column."""
        data, offs = byte_view(column)
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for a, b in chunks(offs, SLICE_BYTES):
            lens = np.diff(offs[a : b + 1])
            n_windows = -(-lens // WINDOW)
            first = np.concatenate(([0], np.cumsum(n_windows)))
            padded = np.zeros(first[-1] * WINDOW, dtype=np.uint8)
            for start, length, w in zip(offs[a:b].tolist(), lens.tolist(), first[:-1].tolist(), strict=True):
                padded[w * WINDOW : w * WINDOW + length] = data[start : start + length]
            padded = padded.reshape(-1, WINDOW)
            step = SLICE_BYTES // WINDOW
            scores = [self.window_scores(padded[k : k + step]) for k in range(0, len(padded), step)]
            if not scores:
                continue
            weight = (padded != 0).sum(axis=1)
            total = np.concatenate(([np.zeros(out.shape[1])], np.cumsum(np.concatenate(scores) * weight[:, None], axis=0)))
            out[a:b] = (total[first[1:]] - total[first[:-1]]) / np.maximum(lens, 1)[:, None]
        return _softmax(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS_PER_DOC windows of each text at places drawn over the whole of it."""
    for batch in batches:
        data, offs = byte_view(batch.column("text"))
        draws = batch.column("draw").to_numpy(zero_copy_only=False)
        rows, windows = [], []
        for i in range(len(batch)):
            length = int(offs[i + 1] - offs[i])
            rng = np.random.default_rng(int(draws[i]) % (1 << 63))
            for at in rng.integers(0, max(1, length - WINDOW + 1), min(WINDOWS_PER_DOC, 1 + length // WINDOW)):
                rows.append(i)
                windows.append(data[offs[i] + at : min(offs[i] + at + WINDOW, offs[i + 1])].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows, pa.int32())), pa.array(windows, pa.binary())], names=["lang", "bytes"])


def train_language_id(labelled: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """Trains on a bounded sample: about DOCS_PER_LANG documents of each language, WINDOWS_PER_DOC windows of each.

    Rows with a null text or language are left out; without any row left there is no network. Repeated rows
    are drawn together. ``key_col`` only takes part in drawing the sample. Over MAX_LANGS languages are an error.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(key_col, text_col).alias("draw")).filter("lang IS NOT NULL AND length(text) > 0")
    sizes = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, DOCS_PER_LANG / r["count"])))])
    drawn = rows.filter(F.pmod("draw", F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    # Repeated texts are drawn together, so each language is held to its own bound.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = drawn.withColumn("rank", rank).filter(F.col("rank") <= 2 * DOCS_PER_LANG).select("text", "lang", "draw")
    got = drawn.mapInArrow(_sample_windows, "lang string, bytes binary").collect()
    got = sorted((r["lang"], bytes(r["bytes"])) for r in got)
    if not got:
        return None
    windows = np.frombuffer(b"".join(b.ljust(WINDOW, b"\0") for _, b in got), dtype=np.uint8).reshape(-1, WINDOW)
    return ByteConvNet.train(windows, [lang for lang, _ in got])


def identify_languages(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its probability, 0 to 1) to the rows of ``docs``.

    A null text, one without a letter, and every text if there is no network, is ``und`` with score 0.
    Of languages that score alike the first by name is taken; repeated rows are judged alike, and an empty
    table gives an empty result. Columns of these two names are replaced; all others pass through, the text
    with any length.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(at)
            known = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
            if model is None or not len(batch):
                pred, score = [UNDETERMINED] * len(batch), np.zeros(len(batch))
            else:
                p = model.text_scores(text)
                best = p.argmax(axis=1)
                score = np.where(known, p[np.arange(len(best)), best], 0.0)
                pred = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(key_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(key_col).cast("string")) % 4 == 2, F.lit(False))
