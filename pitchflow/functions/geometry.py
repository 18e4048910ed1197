"""Column helpers for pixels and metres, and the driver-side homography fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def project(h: np.ndarray, x: Column, y: Column) -> tuple[Column, Column]:
    """Points through a 3 x 3 homography; a zero denominator gives 0."""
    u, v, w = (float(r[0]) * x + float(r[1]) * y + float(r[2]) for r in np.asarray(h))
    return F.when(w == 0, 0.0).otherwise(u / F.nullif(w, F.lit(0.0))), F.when(w == 0, 0.0).otherwise(v / F.nullif(w, F.lit(0.0)))


def metres_to_canvas(v: Column) -> Column:
    """Ten pixels a metre with a margin of four metres, truncated toward zero."""
    return ((v + 4) * 10).cast("int")


def torso_box(x1, y1, x2, y2) -> list[Column]:
    """The band from 15 to 55 percent of a box's height, in whole pixels; the whole box if that is empty."""
    x1, y1, x2, y2 = (F.col(c).cast("int") for c in (x1, y1, x2, y2))
    h = y2 - y1
    top, low = (y1 + h * 0.15).cast("int"), (y1 + h * 0.55).cast("int")
    empty = (low <= top) | (x2 <= x1)
    return [x1.alias("tx1"), F.when(empty, y1).otherwise(top).alias("ty1"), x2.alias("tx2"), F.when(empty, y2).otherwise(low).alias("ty2")]


def fit_homography(pixel: np.ndarray, pitch: np.ndarray, threshold: float = 3.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Normalised direct linear transform on the largest set of points within ``threshold`` metres."""
    pixel, pitch = np.asarray(pixel, float), np.asarray(pitch, float)
    if len(pixel) < 4 or len(pixel) != len(pitch):
        raise ValueError("a homography needs at least four pairs of points")

    def solve(rows) -> np.ndarray | None:
        ts, pts = [], []
        for p in (pixel[rows], pitch[rows]):
            mean = p.mean(axis=0)
            scale = np.sqrt(2) / max(np.linalg.norm(p - mean, axis=1).mean(), 1e-12)
            ts.append(np.array([[scale, 0, -scale * mean[0]], [0, scale, -scale * mean[1]], [0, 0, 1]]))
            pts.append((p - mean) * scale)
        a = []
        for (x, y), (u, v) in zip(*pts, strict=True):
            a += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
        h = np.linalg.inv(ts[1]) @ np.linalg.svd(np.array(a))[2][-1].reshape(3, 3) @ ts[0]
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None

    def errors(h) -> np.ndarray:
        q = np.c_[pixel, np.ones(len(pixel))] @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.linalg.norm(q[:, :2] / q[:, 2:] - pitch, axis=1), nan=np.inf)

    rng, best = np.random.default_rng(seed), None
    for k in range(rounds):
        rows = np.arange(len(pixel)) if k == 0 else rng.choice(len(pixel), 4, replace=False)
        h = solve(rows)
        if h is not None and (inside := errors(h) <= threshold).sum() >= 4 and (best is None or inside.sum() > best.sum()):
            best = inside
        if best is not None and best.all():
            break
    h = None if best is None else solve(np.flatnonzero(best))
    if h is None:
        raise ValueError("no homography fits the points")
    return h


FITTED = "n bigint, mean_error_m double, max_error_m double, " + ", ".join(f"h{i} double" for i in range(9))


def _fits_of_all(pixel: np.ndarray, pitch: np.ndarray, threshold: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """``fit_homography`` of many groups of equally many points: their homographies, and of which groups all points are within ``threshold``.

    That is the first set of points that ``fit_homography`` tries, so these are its fits; the others are to be fitted one by one.
    """
    n, ts, pts = pixel.shape[1], [], []
    for p in (pixel, pitch):
        mean = p.mean(axis=1, keepdims=True)
        scale = np.sqrt(2) / np.maximum(np.linalg.norm(p - mean, axis=2).mean(axis=1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0], t[:, 1, 1], t[:, 2, 2] = scale, scale, 1
        t[:, :2, 2] = -scale[:, None] * mean[:, 0]
        ts.append(t)
        pts.append((p - mean) * scale[:, None, None])
    (x, y), (u, v) = (np.moveaxis(p, 2, 0) for p in pts)
    one, none = np.ones_like(x), np.zeros_like(x)
    a = np.stack([-x, -y, -one, none, none, none, u * x, u * y, u, none, none, none, -x, -y, -one, v * x, v * y, v], axis=2).reshape(len(x), 2 * n, 9)
    h = np.linalg.inv(ts[1]) @ np.linalg.svd(a, full_matrices=2 * n < 9)[2][:, -1].reshape(-1, 3, 3) @ ts[0]
    sound = np.abs(h[:, 2, 2]) > 1e-12
    h = h / np.where(sound, h[:, 2, 2], 1)[:, None, None]
    return h, sound & (np.nan_to_num(_errors(h, pixel, pitch), nan=np.inf) <= threshold).all(axis=1)


def _errors(h: np.ndarray, pixel: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    q = np.concatenate([pixel, np.ones((*pixel.shape[:2], 1))], axis=2) @ h.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.linalg.norm(q[..., :2] / q[..., 2:] - pitch, axis=2)


def _fits(pixel: np.ndarray, pitch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of many groups of equally many points have a fit, their homographies, and their points' errors."""
    h, fitted = np.full((len(pixel), 3, 3), np.nan), np.full(len(pixel), False)
    rows = np.flatnonzero(np.isfinite(pixel).all(axis=(1, 2)) & np.isfinite(pitch).all(axis=(1, 2))) if pixel.shape[1] >= 4 else []
    try:
        if len(rows):
            h[rows], fitted[rows] = _fits_of_all(pixel[rows], pitch[rows])
    except np.linalg.LinAlgError:
        fitted[:] = False
    for i in np.flatnonzero(~fitted):
        try:
            h[i], fitted[i] = fit_homography(pixel[i], pitch[i]), True
        except ValueError:
            h[i] = np.nan
    return fitted, h, _errors(h, pixel, pitch)


def fit_homographies(pairs: DataFrame, by: str = "video") -> DataFrame:
    """The fit of each ``by`` of ``pairs(pixel_x, pixel_y, pitch_x, pitch_y)``: its points, errors in metres, and ``h0`` to ``h8``.

    A group's points are those that someone clicked, so they fit in a task. Without a fit, and with under four points, errors and
    numbers are null. The groups of a batch with equally many points are fitted at once.
    """
    places = ["pixel_x", "pixel_y", "pitch_x", "pitch_y"]
    names = [by, *(c.split()[0] for c in FITTED.split(", "))]

    def changes(t: pa.Table) -> np.ndarray:
        key = t[by].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])

    def fit(t: pa.Table) -> pa.RecordBatch:
        first = changes(t)
        n, at = np.diff(np.r_[first, len(t)]), np.column_stack([t[c].to_numpy() for c in places]).astype(float)
        fitted, told = np.full(len(n), False), np.full((len(n), 11), np.nan)
        for size in np.unique(n):
            k = np.flatnonzero(n == size)
            points = at[first[k][:, None] + np.arange(size)]
            fitted[k], h, error = _fits(points[..., :2], points[..., 2:])
            told[k] = np.column_stack([error.mean(axis=1), error.max(axis=1), h.reshape(-1, 9)])
        return pa.RecordBatch.from_arrays([t[by].take(pa.array(first)).combine_chunks(), pa.array(n, pa.int64()), *(pa.array(c, mask=~fitted) for c in told.T)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            last = int(changes(t)[-1]) if len(t) else 0  # its points may go on in the next batch
            if last:
                yield fit(t.slice(0, last).combine_chunks())
            held = t.slice(last)
        if held is not None and len(held):
            yield fit(held.combine_chunks())

    schema = T.StructType([pairs.schema[by], *T.StructType.fromDDL(FITTED).fields])
    return pairs.select(by, *places).repartition(by).sortWithinPartitions(by).mapInArrow(run, schema)
