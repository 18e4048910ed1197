"""Images as tables: PNG and PPM files to rows of pixels, whole or cut to boxes, in bounded batches."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGN = b"\x89PNG\r\n\x1a\n"
#: Channels of the PNG colour types that are read, all of 8 bits.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels of an output batch at most.
PIXELS = 1 << 17


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(bgr: np.ndarray) -> bytes:
    """A PNG of an array of height, width and b, g, r."""
    h, w, _ = bgr.shape
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), bgr[:, :, ::-1].astype(np.uint8).reshape(h, -1)], axis=1)
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, n: int) -> np.ndarray:
    """Rows of bytes without their PNG filters; ``n`` bytes a pixel."""
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1 + n), dtype=np.uint8)
    for y, row in enumerate(raw, 1):
        kind, line, up = row[0], row[1:], out[y - 1]
        here = out[y]
        if kind == 0:
            here[n:] = line
        elif kind == 1:
            here[n:] = line.reshape(-1, n).cumsum(axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            here[n:] = line + up[n:]
        elif kind in (3, 4):
            for i in range(len(line)):
                a, b, c = int(here[i]), int(up[i + n]), int(up[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc_ = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c
                here[i + n] = (int(line[i]) + guess) & 255
        else:
            raise ValueError("a PNG row of an unknown filter")
    return out[1:, n:]


def decode(content: bytes) -> np.ndarray:
    """Height, width and b, g, r of a PNG of 8 bits without interlacing (alpha is left out) or of a PPM (P6)."""
    if content[:2] == b"P6":
        head = re.match(rb"P6(?:\s+|#[^\n]*\n)*(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s", content)
        if not head:
            raise ValueError("a PPM without a head of 8 bits")
        w, h = int(head[1]), int(head[2])
        return np.frombuffer(content, np.uint8, h * w * 3, head.end()).reshape(h, w, 3)[:, :, ::-1]
    if content[:8] != _SIGN:
        raise ValueError("neither PNG nor PPM")
    at, data, shape = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
    if shape is None or shape[2] != 8 or shape[3] not in _CHANNELS or shape[6]:
        raise ValueError("a PNG of a kind that isn't read")
    w, h, n = shape[0], shape[1], _CHANNELS[shape[3]]
    got = _unfiltered(np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n), n).reshape(h, w, n)
    return np.repeat(got[:, :, :1], 3, axis=2) if n < 3 else got[:, :, 2::-1]


def _batches(keys: list[pa.Array], parts: list[tuple[int, np.ndarray, int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """``parts`` are the row of a key, its pixels and where they begin."""
    if not parts:
        return
    row = pa.array(np.concatenate([np.full(p.shape[0] * p.shape[1], i) for i, p, _, _ in parts]))
    y, x = (np.concatenate([g.ravel() + o for g, o in zip((np.indices(p.shape[:2])[k] for _, p, _, _ in parts), (q[2 + k] for q in parts), strict=True)]) for k in (0, 1))
    bgr = np.concatenate([p.reshape(-1, 3) for _, p, _, _ in parts])
    yield pa.RecordBatch.from_arrays([*(k.take(row) for k in keys), pa.array(x, pa.int32()), pa.array(y, pa.int32()), *(pa.array(bgr[:, c].astype(np.int32)) for c in range(3))], names=names)


_XYBGR = [T.StructField(c, T.IntegerType()) for c in ("x", "y", "b", "g", "r")]


def image_pixels(images: DataFrame, *keep: str, content: str = "content") -> DataFrame:
    """One row a pixel of each image: the columns ``keep``, ``x``, ``y``, ``b``, ``g``, ``r``. A null image has none."""
    rows = images.filter(F.col(content).isNotNull()).select(*keep, F.col(content).alias("content"))
    schema = T.StructType([*(rows.schema[c] for c in keep), *_XYBGR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size = [batch.column(c) for c in keep], [], 0
            for i, data in enumerate(batch.column("content").to_pylist()):
                image = decode(data)
                for at in range(0, len(image), max(1, PIXELS // max(1, image.shape[1]))):
                    part = image[at : at + max(1, PIXELS // max(1, image.shape[1]))]
                    held.append((i, part, at, 0))
                    size += part.shape[0] * part.shape[1]
                    if size >= PIXELS:
                        yield from _batches(keys, held, schema.names)
                        held, size = [], 0
            yield from _batches(keys, held, schema.names)

    return rows.mapInArrow(run, schema)


def crop_pixels(images: DataFrame, boxes: DataFrame, on: list[str], content: str = "content") -> DataFrame:
    """``crop``, ``b``, ``g``, ``r``: the pixels of ``boxes(*on, crop, x1, y1, x2, y2)`` in the images that they are of.

    Each image is decoded once, for all its boxes; what lies outside of it has no pixels.
    """
    near = boxes.groupBy(*on).agg(F.collect_list(F.struct("crop", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))).alias("boxes"))  # an image's boxes are few
    rows = images.select(*on, F.col(content).alias("content")).filter("content IS NOT NULL").join(near, on).select("content", "boxes")
    schema = T.StructType([T.StructField("crop", boxes.schema["crop"].dataType), *_XYBGR[2:]])
    names = schema.names

    def told(held: list[tuple[int, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
        crop = pa.array([c for c, _ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), [len(p) for _, p in held])))
        bgr = np.concatenate([p for _, p in held])
        return pa.RecordBatch.from_arrays([crop, *(pa.array(bgr[:, c].astype(np.int32)) for c in range(3))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, kind = [], 0, batch.column("boxes").type.value_type.field("crop").type
            for data, asked in zip(batch.column("content"), batch.column("boxes"), strict=True):
                image = decode(data.as_py())
                for b in asked.as_py():
                    part = image[max(0, b["y1"]) : max(0, b["y2"]), max(0, b["x1"]) : max(0, b["x2"])].reshape(-1, 3).copy()  # not the whole image
                    held.append((b["crop"], part))
                    size += len(part)
                    if size >= PIXELS:
                        yield told(held, kind)
                        held, size = [], 0
            if held:
                yield told(held, kind)

    return rows.mapInArrow(run, schema)


def with_hue(pixels: DataFrame) -> DataFrame:
    """Adds hue ``h`` (0 to 179, two degrees each) and saturation ``s`` (0 to 255) of ``b``, ``g``, ``r``, rounded half up."""
    b, g, r = (F.col(c).cast("double") for c in "bgr")
    most, least = F.greatest(b, g, r), F.least(b, g, r)
    span = F.nullif(most - least, F.lit(0.0))
    turn = F.when(most == r, 30 * (g - b) / span).when(most == g, 60 + 30 * (b - r) / span).otherwise(120 + 30 * (r - g) / span)
    h = F.floor(F.when(turn < 0, turn + 180).otherwise(turn) + 0.5) % 180
    s = F.floor(255 * (most - least) / F.nullif(most, F.lit(0.0)) + 0.5)
    return pixels.withColumns({"h": F.coalesce(h, F.lit(0)).cast("int"), "s": F.coalesce(s, F.lit(0)).cast("int")})


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Writes ``files(name, content)`` as files of these names below ``path``; returns ``name`` and ``length`` of each.

    A file comes into place by a rename once it is whole, so that a task that is run again writes the same files.
    """
    where = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([len(c) for c in batch.column("content").to_pylist()], pa.int64())], names=["name", "length"])

    return files.select("name", "content").mapInArrow(run, "name string, length bigint")
