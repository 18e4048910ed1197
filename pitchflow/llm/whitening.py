"""Whitening of vectors by a tall-skinny QR (Demmel et al., 2012): no covariance matrix is formed for the fit.

Entries become whole numbers, so that their sums, and with them each row's distance from the mean, are
exact. A task reduces its centred rows to one triangular factor; factors are merged FAN at a time, level
by level, and the singular values and right vectors of the last one whiten the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table

#: Parts that one task merges; numbers of rows that go into a factor at once.
FAN, ROWS = 8, 4096
#: Whole numbers may have so many bits, so that sums over a task are exact.
MOST_BITS = 40
#: A direction whose singular value is smaller than the largest by this factor has no variance but rounding.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Grid:
    """How an entry c becomes a whole number: floor(scale * c) + offset."""

    scale: float = 1024.0
    offset: int = 100_000


@dataclass
class Whitening:
    """``directions`` has a unit vector a column, ``values`` their variances, ``trace`` the sum of all variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector isn't null and has finite entries only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.filter(F.col(vec_col).isNotNull() & F.forall(F.col(vec_col).cast("array<double>"), finite))


def _whole(column: pa.Array, grid: Grid) -> np.ndarray:
    """One row of whole numbers a vector."""
    lengths = np.asarray(column.value_lengths())
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors of unlike lengths")
    flat = np.floor(np.asarray(column.flatten()) * grid.scale)
    if len(flat) and np.abs(flat).max() >= 1 << MOST_BITS:
        raise ValueError(f"an entry has over {MOST_BITS} bits")
    return flat.astype(np.int64).reshape(len(column), -1) + grid.offset


def _sums(grid: Grid) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if len(batch):
                x = _whole(batch.column("vec"), grid)
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError("vectors of unlike lengths")
                total, n = x.sum(axis=0) + (0 if total is None else total), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["place", "s", "n"])

    return run


class _Centre:
    """Rows less their mean: exact as whole numbers n * x - S, rounded once as doubles."""

    def __init__(self, n: int, sums: list[int], grid: Grid):
        self.n, self.grid, self.d = n, grid, len(sums)
        self.near, self.rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)

    def exact(self, column: pa.Array) -> np.ndarray:
        y = _whole(column, self.grid) - self.near
        if len(y) and (int(np.abs(y).max()) + 1) * self.n >= 1 << 62:
            y = y.astype(object)
        return y * self.n - self.rest

    def doubles(self, column: pa.Array) -> np.ndarray:
        return (self.exact(column) / self.n).astype(float)


def _squares(exact: np.ndarray) -> pa.Array:
    """Sum of the squares of each row, exact."""
    kind = pa.decimal128(38, 0)
    if exact.dtype != object and (not len(exact) or exact.shape[1] * float(np.abs(exact).max()) ** 2 < 1 << 62):
        return pa.array((exact * exact).sum(axis=1)).cast(kind)
    return pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in exact], kind)


def _factors(centre: _Centre) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, centre.d))
        for batch in batches:
            x = centre.doubles(batch.column("vec"))
            for at in range(0, len(x), ROWS):
                r = np.linalg.qr(np.concatenate([r, x[at : at + ROWS]]), mode="r")
        if len(r):
            yield _part(r.ravel())

    return run


def _part(value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.list_(pa.float64()))], names=["part", "value"])


PART = "part bigint, value array<double>"


def merged_factors(d: int) -> Callable[[list[np.ndarray]], np.ndarray]:
    return lambda parts: np.linalg.qr(np.concatenate([p.reshape(-1, d) for p in parts]), mode="r").ravel()


def _unpacked(part: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    return part[0], part[1 : k + 1], part[k + 1 :].reshape(k, k)


def merged_moments(k: int) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Number, mean and centred products of the rows of several parts (Chan et al., 1979)."""

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        n, mean, products = _unpacked(parts[0], k)
        for part in parts[1:]:
            m, other, more = _unpacked(part, k)
            off = other - mean
            products = products + more + np.outer(off, off) * (n * m / (n + m))
            n, mean = n + m, mean + off * (m / (n + m))
        return np.concatenate([[n], mean, products.ravel()])

    return merge


def tree_merge(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """What ``merge`` makes of all ``parts(part, value)``, FAN at a time; None if there are none. Each level is a written table."""

    def level(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        return pd.DataFrame({"part": [int(p["part"].iloc[0]) // FAN], "value": [merge([np.asarray(v) for v in p["value"]])]})

    now = Table(parts, "parts")
    while (last := now.df.agg(F.max("part")).first()[0]) is not None and last > 0:
        up = Table(now.df.groupBy(F.expr(f"part div {FAN}")).applyInPandas(level, PART), "parts")
        now.drop()
        now = up
    row = now.df.first()
    now.drop()
    return None if row is None else np.array(row["value"])


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", components: int = 8, grid: Grid = Grid()) -> Whitening | None:
    """The ``components`` directions of most variance of all usable vectors; None without any.

    The table is read twice: for the sums, then for the factors. One number a dimension and one factor come to the driver.
    """
    rows = usable(vectors, vec_col).select(F.col(vec_col).cast("array<double>").alias("vec"))
    sums = rows.mapInArrow(_sums(grid), "place bigint, s bigint, n bigint").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("place").collect()
    if not sums:
        return None
    if len({r["n"] for r in sums}) > 1:
        raise ValueError("vectors of unlike lengths")
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    centre = _Centre(n, total, grid)
    r = tree_merge(rows.mapInArrow(_factors(centre), PART), merged_factors(centre.d)).reshape(-1, centre.d)
    _, sigma, right = np.linalg.svd(r, full_matrices=False)
    k = int((sigma > NO_VARIANCE * sigma[0]).sum()) if sigma[0] > 0 else 0
    k = min(k, components)
    directions = right[:k].T * np.sign(right[np.arange(k), np.abs(right[:k]).argmax(axis=1)])
    return Whitening(n, total, directions, sigma[:k] ** 2 / n, float((sigma**2).sum() / n))


def _applied(model: Whitening, grid: Grid) -> tuple[_Centre, np.ndarray]:
    return _Centre(model.n, model.sums, grid), model.directions / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding", grid: Grid = Grid()) -> float:
    """Largest entry, in absolute value, of the whitened vectors' covariance less the identity."""
    centre, by = _applied(model, grid)
    k = by.shape[1]
    merge = merged_moments(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if len(batch):
                w = centre.doubles(batch.column("vec")) @ by
                mean = w.mean(axis=0)
                part = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                held = part if held is None else merge([held, part])
        if held is not None:
            yield _part(held)

    rows = usable(vectors, vec_col).select(F.col(vec_col).cast("array<double>").alias("vec"))
    n, _, products = _unpacked(tree_merge(rows.mapInArrow(run, PART), merge), k)
    return float(np.abs(products / n - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, grid: Grid = Grid()) -> DataFrame:
    """``vec_id``, ``n``, ``deviation`` (of n * x from S, squared and summed, exact), ``whitened`` and ``explained``
    (arrays by component, falling variance), ``identity_error``; one row for each usable vector.

    * Vectors that are null or hold null, NaN or infinite entries are left out everywhere.
    * Directions without variance aren't returned, so that arrays may be shorter than ``components``, and empty
      if all vectors are alike. Equal variances: the directions are some basis of their space, the same for all rows.
    * Vectors of unlike lengths, and whole numbers of over 40 bits, are errors.
    * Repeated rows count, and come back, as often as they occur; a null id is an id like any other.
    * Only the two columns named are read; a row's numbers must fit in a task, and a square of its length.
    * An empty table, or one without a usable vector, gives an empty result.
    """
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    model = fit_whitening(vectors, vec_col, components, grid)
    if model is None:
        rows, n, share, error = vectors.sparkSession.createDataFrame([], schema), 0, [], None
    else:
        centre, by = _applied(model, grid)
        n, share = model.n, [float(v) for v in model.values / model.trace] if len(model.values) else []
        error = identity_error(vectors, model, vec_col, grid) if share else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                exact = centre.exact(batch.column("vec")).reshape(len(batch), centre.d)
                w = (exact / centre.n).astype(float) @ by
                told = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * by.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _squares(exact), told], names=["vec_id", "deviation", "whitened"])

        rows = usable(vectors, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, schema)
    explained = F.array(*map(F.lit, share)).cast("array<double>").alias("explained")
    return rows.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained, F.lit(error).cast("double").alias("identity_error"))
