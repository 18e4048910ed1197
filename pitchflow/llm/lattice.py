"""Likelihood of texts under a unigram subword model, summed over all segmentations.

A text is its words, each with a mark of its beginning, and an end. Pieces never reach over a word's
beginning, so that the lattice of a text falls apart into those of its words: the forward recursion, in logs,
is run once for each distinct word of the corpus, and a text adds up its words. The vocabulary and its scores
exist already; they are the prior, and training documents re-weight the pieces by expected counts over their
lattices (Kudo, 2018). A character without a piece is spelt in bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Answers, answers_of, numbered_blocks
from .common import Table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of re-weighting, and how many expected counts the vocabulary's own scores stand for, for each piece.
ROUNDS, PRIOR = 2, 1.0
#: Words are taken together up to so many characters; a longer word is taken alone.
CHUNK_CHARS = 1 << 17

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWER)) if text else []


@dataclass
class Pieces:
    """Pieces with their log weights; a leading space marks a word's beginning. ``bytes_`` are the log weights of the 256
    bytes, ``end`` that of a text's end. All weights together are 1."""

    pieces: list[str]
    weights: np.ndarray
    bytes_: np.ndarray
    end: float


def read_vocabulary(path: str = VOCABULARY) -> Pieces:
    """The pieces that a lower-cased word can have. Scores that are whole numbers count merges: piece number r weighs 1 / (r + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "▁" not in piece[1:] and not re.search(r"[A-Z\x09-\x0D ]", piece):
            found[piece.replace("▁", " ")] = model.get_score(i)
    score = np.array([*found.values()])
    logs = -np.log1p(-score) if (score <= 0).all() and (score == np.floor(score)).all() else score
    rare = np.full(256, logs.min())
    total = np.logaddexp.reduce(np.concatenate([logs, rare, [logs.min()]]))
    return Pieces([*found], logs - total, rare - total, float(logs.min() - total))


class Lattice:
    """All segmentations of many words at once. ``edges`` go from one place of a word to a later one."""

    def __init__(self, model: Pieces):
        self.model, self.lengths = model, np.array([len(p) for p in model.pieces], dtype=np.int64)
        self.matcher = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        self.unknown = re.compile("[^" + "".join(re.escape(p) for p in model.pieces if len(p) == 1) + "]")

    def edges(self, words: list[str]) -> None:
        text = " " + " ".join(words)
        lens = np.array([len(w) + 1 for w in words])
        found = np.fromiter(chain.from_iterable(self.matcher.iter(text)), dtype=np.int64).reshape(-1, 2)
        spelt = [(m.start(), m[0].encode()) for m in self.unknown.finditer(text)]
        self.spelt = [b for _, b in spelt]
        start = np.concatenate([found[:, 0] + 1 - self.lengths[found[:, 1]], np.array([at for at, _ in spelt], dtype=np.int64)])
        stop = np.concatenate([found[:, 0] + 1, np.array([at + 1 for at, _ in spelt], dtype=np.int64)])
        self.piece = np.concatenate([found[:, 1], np.full(len(spelt), -1)])
        self.log = np.concatenate([self.model.weights[found[:, 1]], [self.model.bytes_[[*b]].sum() for b in self.spelt]])
        first = np.cumsum(lens) - lens
        self.word = np.searchsorted(first, start, side="right") - 1
        # A word has a place more than characters.
        self.start, self.stop = start + self.word, stop + self.word
        self.first = first + np.arange(len(words))
        self.last = self.first + lens
        self.places = int(lens.sum()) + len(words)
        self.lens = lens

    def _sums(self, known: np.ndarray, from_: np.ndarray, to: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log sums over all paths, place by place: those at ``to`` after ``step`` characters come from ``from_``."""
        out = np.full(self.places, -np.inf)
        out[known] = 0.0
        order = np.argsort(step * self.places + to, kind="stable")
        from_, to, log = from_[order], to[order], self.log[order]
        cuts = np.flatnonzero(np.diff(step[order])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            x, heads = out[from_[a:b]] + log[a:b], np.flatnonzero(np.concatenate(([True], to[a + 1 : b] != to[a : b - 1])))
            most = np.maximum.reduceat(x, heads)
            of = np.repeat(most, np.diff(np.concatenate([heads, [b - a]])))
            out[to[a:b][heads]] = most + np.log(np.add.reduceat(np.exp(x - of), heads))
        return out

    def forward(self) -> np.ndarray:
        return self._sums(self.first, self.start, self.stop, self.stop - self.first[self.word])

    def backward(self) -> np.ndarray:
        return self._sums(self.last, self.stop, self.start, self.last[self.word] - self.start)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log of the probability of each word, over all its segmentations."""
        self.edges(words)
        return self.forward()[self.last]

    def expected(self, words: list[str], times: np.ndarray, into: np.ndarray) -> None:
        """Adds how often each piece, then each byte, is expected in the words."""
        self.edges(words)
        a, b = self.forward(), self.backward()
        share = np.exp(a[self.start] + self.log + b[self.stop] - a[self.last][self.word]) * times[self.word]
        whole = self.piece >= 0
        n = len(self.model.pieces)
        into[:n] += np.bincount(self.piece[whole], weights=share[whole], minlength=n)
        for spelling, s in zip(self.spelt, share[~whole].tolist(), strict=True):
            for x in spelling:
                into[n + x] += s


def _chunks(words: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, w in enumerate(words):
        if i > a and size + len(w) > CHUNK_CHARS:
            yield a, i
            a, size = i, 0
        size += len(w) + 1
    if words:
        yield a, len(words)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [w.decode() for w in batch.column("word").to_pylist()]


def fit_pieces(counts: DataFrame, ends: int, model: Pieces, rounds: int = ROUNDS) -> Pieces:
    """``model`` with the weights that training words ``counts(word, c)`` and ``ends`` text ends give it.

    Each round adds up expected counts by piece; as many numbers as the vocabulary has pieces come to the driver.
    """
    spark, n = counts.sparkSession, len(model.pieces)
    prior = np.exp(np.concatenate([model.weights, model.bytes_]))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, got = Lattice(shared.value), np.zeros(n + 256)  # noqa: B023
            for batch in batches:
                words, times = _texts(batch), batch.column("c").to_numpy()
                for a, b in _chunks(words):
                    lattice.expected(words[a:b], times[a:b], got)
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["piece", "n"])

        got = counts.filter("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        seen = PRIOR * n * prior
        seen[[r["piece"] for r in got]] += [r["n"] for r in got]
        logs = np.log(np.concatenate([seen, [ends + PRIOR]]) / (seen.sum() + ends + PRIOR))
        model = Pieces(model.pieces, logs[:n], logs[n : n + 256], float(logs[-1]))
    return model


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block, and how often they are in its training texts (again for each task with a part of it)."""
    now, held = None, Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, c = [*held], [*held.values()]
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), pa.array(part, pa.binary()), pa.array(c[at : at + 50_000], pa.int64())], names=["block", "word", "c"])

    for batch in batches:
        for block, apart, text in zip(batch.column("block").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if block != now:
                yield from out()
                now, held = block, Counter()
            found = words_of(text)
            held.update(dict.fromkeys(found, 0) if apart else found)
    yield from out()


def _likelihoods(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            words = _texts(batch)
            logs = [lattice.likelihoods(words[a:b]) for a, b in _chunks(words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "c")), pa.array(np.concatenate(logs) if logs else np.zeros(0))], names=["word", "c", "log"])

    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every whole text.

    Training counts documents for which the column ``held_out`` is false. Tokens are words and one end a text; ``n_known`` are in the
    training texts; ``base_score`` is the log10 of their probability with one added to each count, ``score`` that of
    the subword model. Texts are written as blocks, which ask for each of their words once.

    * A null or empty text is an end alone. A word may be as long as a task can hold.
    * Without a training document the vocabulary's own scores are the model, and the base is 1 for each token.
    * Repeated rows are counted and scored each; a null id is an id like any other, and other columns aren't read.
    * An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks = numbered_blocks(rows)
    asked_table = Table(blocks.select("block", "held_out", "text").mapInArrow(_asked, "block bigint, word binary, c bigint"), "asked")
    asked = asked_table.df
    words_table = Table(asked.groupBy("word").agg(F.sum("c").alias("c")), "words")
    counts = words_table.df
    ends = blocks.filter("NOT held_out").count()
    seen = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (seen[0] or 0) + ends, (seen[1] or 0) + (ends > 0)
    model = read_vocabulary(vocabulary)
    if ends:
        model = fit_pieces(counts, ends, model, rounds)
    told = counts.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)), "word binary, c bigint, log double")
    # A word is asked for once a block, so no word has more rows than there are blocks.
    answers = Answers(asked.select("block", "word").join(told, "word"), "word")
    asked_table.drop()
    words_table.drop()
    base, end_log, path = float(np.log10(total + distinct + 1)), model.end / np.log(10), answers.path
    end_base = float(np.log10(ends + 1)) - base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        now, place, c, log = None, {}, np.zeros(0), np.zeros(0)
        for batch in batches:
            n, known, simple, whole = [], [], [], []
            for block, bucket, text in zip(*(batch.column(x).to_pylist() for x in ("block", "bucket", "text")), strict=True):
                found = words_of(text)
                if found and block != now:
                    got = answers_of(files, f"{root}/bucket={bucket}", block, ["word", "c", "log"])
                    now, place = block, {w: i for i, w in enumerate(got["word"].to_pylist())}
                    c, log = got["c"].to_numpy(), got["log"].to_numpy() / np.log(10)
                    plain = np.log10(c + 1.0) - base
                at = np.array([*map(place.__getitem__, found)], dtype=np.int64)
                n.append(len(found) + 1)
                known.append(int((c[at] > 0).sum()) + (ends > 0) if found else int(ends > 0))
                simple.append((plain[at].sum() if found else 0.0) + end_base)
                whole.append((log[at].sum() if found else 0.0) + end_log)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([total] * len(n), pa.int64()), pa.array(simple, pa.float64()), pa.array(whole, pa.float64())], names=schema.names)

    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score"))])
    return blocks.select("*", answers.bucket).mapInArrow(run, schema)
