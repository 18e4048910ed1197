"""Token ids in training order, as fixed-stride binary shards.

Texts are encoded with a public vocabulary and cut into sequences of SEQ_LEN ids. Sequence number i of
N goes to slot P(i), where P is a keyed Feistel permutation of 0..N-1 (cycle-walking skips what lies
beyond N), so the training order needs no sort and can be computed for any slot. Shards are ranges of
slots; each is one file of equal records, so a reader resumes anywhere with one seek.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, bounded_batches, new_path
from .shingles import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of that vocabulary: its splitting pattern, and the free id that ends a text and fills the last sequence.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
SEQ_LEN = 512
SHARD_BYTES = 64 << 20
#: Tasks that write shards, at most; beyond it a task writes a range of shards, one after the other.
WRITE_TASKS = 20_000
#: Texts longer than this are encoded in parts, cut before a space or line end, as the pattern cuts there too.
PART_CHARS = 1 << 20
ROUNDS = 6
#: zstd level of the ids on their way to the shards.
LEVEL = 6


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return (right << half) | left

    def _walk(self, x, keys) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), keys)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, number) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot) -> np.ndarray:
        """Inverse of ``slot``; the same rounds in reverse order, as the halves end swapped."""
        return self._walk(slot, self.keys[::-1])


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("pitchflow", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_parts(text: str) -> Iterator[str]:
    """The text, or parts of it from one space after a letter or digit to the next such place past PART_CHARS."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = at + PART_CHARS
        while (cut := text.find(" ", cut)) >= 0 and not (text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _sequences(shared, seq_len: int):
    """Chains the texts of a task, an end id after each, and cuts the chain in sequences."""

    def cut(flat: np.ndarray, ids: pa.Array, lens: np.ndarray, n: int) -> pa.RecordBatch:
        ends = np.cumsum(lens)
        start = np.arange(n) * seq_len
        stop = np.minimum(start + seq_len, ends[-1])
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop - 1, side="right")
        counts = last - first + 1
        begin = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        owner = np.repeat(np.arange(n), counts)
        text = np.arange(begin[-1]) - begin[owner] + first[owner]
        inside = np.minimum(ends[text], stop[owner]) - np.maximum(ends[text] - lens[text], start[owner])
        lists = [pa.ListArray.from_arrays(pa.array(begin), x) for x in (ids.take(pa.array(text)), pa.array(inside.astype(np.int32)))]
        data = [x.tobytes() for x in flat[: n * seq_len].reshape(n, seq_len)]
        return pa.RecordBatch.from_arrays([*lists, pa.array(data, pa.binary())], names=["doc_ids", "lens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(shared.value)
        flat, ids, lens = np.zeros(0, dtype="<u2"), None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            full = [i for i, text in enumerate(texts) if text]
            got = [np.array([x for part in text_parts(texts[i]) for x in encoding.encode_ordinary(part)] + [END], dtype="<u2") for i in full]
            new = batch.column("doc_id").take(pa.array(full, pa.int32()))
            flat, ids = np.concatenate([flat, *got]), new if ids is None else pa.concat_arrays([ids, new])
            lens = np.concatenate([lens, [len(x) for x in got]]).astype(np.int64)
            if n := len(flat) // seq_len:
                yield cut(flat, ids, lens, n)
                ends, flat = np.cumsum(lens), flat[n * seq_len :]
                left = int(np.searchsorted(ends, n * seq_len, side="right"))
                ids, lens = ids[left:], lens[left:].copy()
                if len(lens):
                    lens[0] = ends[left] - n * seq_len
        if len(flat):
            yield cut(np.concatenate([flat, np.full(seq_len - len(flat), END, dtype="<u2")]), ids, lens, 1)

    return run


def write_training_order(docs: DataFrame, out_dir: str | None = None, key: int = 1, seq_len: int = SEQ_LEN, shard_bytes: int = SHARD_BYTES, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns one row per sequence.

    Columns: ``slot``, ``number`` (before the permutation), ``shard`` (file ``shard-########.bin``),
    ``offset`` (bytes into it), ``doc_ids`` (of the texts that it has tokens of) and ``lens`` (how many of
    each, with its end id). Each record is ``seq_len`` unsigned 16-bit little-endian ids. The texts of an
    input split follow one another, each closed by the end id; the split's last record is filled with it.

    * A null or empty text has no tokens. Repeated rows are written as often as they occur.
    * A long text goes on through as many sequences as it needs; its ids must fit in a task.
    * Other columns than the two named aren't read.
    * How texts share sequences depends on how the input is split; that every text is whole, in
      successive numbers, and that the slots are 0..N-1 does not.
    * An empty table writes no shard and gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as f:
        words = spark.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_list, int_list = T.StructField("doc_ids", T.ArrayType(texts.schema["doc_id"].dataType)), T.StructField("lens", T.ArrayType(T.IntegerType()))
    schema = T.StructType([id_list, int_list, T.StructField("ids", T.BinaryType())])
    stored = Table(texts.mapInArrow(_sequences(words, seq_len), schema), "sequences", level=LEVEL)

    # A sequence's number is its file's first number and its row in that file: one count per file, no sort.
    numbered = stored.df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = sorted((r["file"], r["count"]) for r in numbered.groupBy("file").count().collect())
    first, total = {}, 0
    for file, n in counts:
        first[file], total = total, total + n
    base = out_dir or new_path(spark, "shards")
    stride = 2 * seq_len
    per_shard = max(1, shard_bytes // stride)
    n_shards = max(1, -(-total // per_shard))
    starts = spark.sparkContext.broadcast(first)

    longs = T.ArrayType(T.LongType())
    pack = T.StructType([T.StructField("shard", T.LongType()), T.StructField("slots", longs), T.StructField("numbers", longs), T.StructField("doc_ids", T.ArrayType(id_list.dataType)), T.StructField("lens", T.ArrayType(int_list.dataType)), T.StructField("blob", T.BinaryType())])
    packed = numbered.mapInArrow(_pack_by_shard(starts, total, key, per_shard), pack)
    done = T.StructType([*(T.StructField(c, T.LongType()) for c in ("slot", "number", "shard", "offset")), id_list, int_list])
    # A task has a range of shards and fills them one by one.
    tasks = min(n_shards, WRITE_TASKS)
    ranged = packed.repartitionById(tasks, F.expr(f"shard * {tasks} div {n_shards}").cast("int"))
    if tasks < n_shards:
        ranged = ranged.sortWithinPartitions("shard")
    return ranged.mapInArrow(_write_shards(base, total, per_shard, stride), done)


def _pack_by_shard(starts, total: int, key: int, per_shard: int, flush_bytes: int = 16 << 20):
    """Gives each sequence its slot and packs those of one shard together, compressed, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        permutation, pack = Feistel(total, key), zstandard.ZstdCompressor(level=LEVEL)
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            begin = {f: starts.value[f] for f in set(table.column("file").to_pylist())}
            number = np.array([begin[f] for f in table.column("file").to_pylist()], dtype=np.int64) + table.column("row").to_numpy(zero_copy_only=False)
            slots = permutation.slot(number)
            order = np.argsort(slots)
            slots, number, ids = slots[order], number[order], table.column("ids")
            shard = slots // per_shard
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))).astype(np.int32)
            blobs = [pack.compress(b"".join(ids[int(i)].as_py() for i in order[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (pa.array(slots), pa.array(number), *(table.column(c).take(pa.array(order)) for c in ("doc_ids", "lens")))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), *lists, pa.array(blobs, pa.binary())], names=["shard", "slots", "numbers", "doc_ids", "lens", "blob"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= flush_bytes:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _write_shards(base: str, total: int, per_shard: int, stride: int):
    """Fills each shard in memory (it has a fixed size) and moves the finished file into place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        files, root = fs.FileSystem.from_uri(base)
        files.create_dir(root, recursive=True)
        now, data, told = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            name = f"{root}/shard-{now:08d}.bin"
            part = f"{name}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write(data)
            files.move(part, name)
            yield from told

        for batch in batches:
            for i in range(len(batch)):
                shard = batch.column("shard")[i].as_py()
                if shard != now:
                    if now is not None:
                        yield from close()
                    now, told = shard, []
                    data = np.zeros((min(per_shard, total - now * per_shard), stride), dtype=np.uint8)
                slots, numbers, ids, lens = (batch.column(c)[i].values for c in ("slots", "numbers", "doc_ids", "lens"))
                at = slots.to_numpy() - now * per_shard
                data[at] = np.frombuffer(unpack.decompress(batch.column("blob")[i].as_py()), dtype=np.uint8).reshape(-1, stride)
                told.append(pa.RecordBatch.from_arrays([slots, numbers, pa.array(np.full(len(at), now)), pa.array(at * stride), ids, lens], names=["slot", "number", "shard", "offset", "doc_ids", "lens"]))
        if now is not None:
            yield from close()

    return run


def read_sequences(out_dir: str, first: int, count: int, seq_len: int = SEQ_LEN, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """``count`` sequences from slot ``first`` on, in training order; fewer at the end of the last shard."""
    stride = 2 * seq_len
    per_shard, files_root = max(1, shard_bytes // stride), fs.FileSystem.from_uri(out_dir)
    files, root = files_root
    parts, end = [], first + count
    while first < end:
        shard, at = divmod(first, per_shard)
        path = f"{root}/shard-{shard:08d}.bin"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            break
        with files.open_input_file(path) as f:
            f.seek(at * stride)
            got = f.read(min(end - first, per_shard - at) * stride)
        parts.append(np.frombuffer(got, dtype="<u2").reshape(-1, seq_len))
        if not len(parts[-1]):
            break
        first += len(parts[-1])
    return np.concatenate(parts) if parts else np.zeros((0, seq_len), dtype="<u2")
