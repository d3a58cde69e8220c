"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

Entries become whole numbers first (``floor(scale * c) + shift``), so that counts, sums and deviations are exact. The
covariance V (divisor n, centred before multiplying) is never formed: one *pass* gives V @ block for a thin block of
columns. Every task multiplies its rows, taken relative to the mean, and returns one partial product; partial products
are added up by matrix row in a shuffle, so the driver only ever holds d x block numbers.

A round filters the block with a Chebyshev polynomial of V, evaluated by its three-term recurrence with one pass for
each degree. On the unwanted interval, from a lower bound of the spectrum (a short Lanczos run) to the smallest Ritz
value of the block, the polynomial stays below one; above it grows, which damps the unwanted part. The filtered block is
made orthonormal (QR) and its Ritz pairs are taken (Rayleigh-Ritz). Rounds end when every wanted pair is certified: the
norm of V q - e q is at most ``tolerance`` times the largest eigenvalue, or at the level where rounding stops further
progress, which must lie below ``worst``.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of
another length than the most frequent one (ties: the longer) and entries whose whole number does not fit a long. Null
and repeated keys stay as rows of their own. A component without variance (eigenvalue not above rounding) has no
whitened value (null). Without rows the result is empty; fewer dimensions than components give one component each.
Other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.session import freeze

COMPONENTS, GUARD, DEGREE = 32, 16, 10
SCALE, SHIFT = 64, 1_000_000
TOLERANCE, WORST, MOST_ROUNDS = 2e-14, 1e-9, 200
#: Rows that one numpy step holds.
STEP = 8192
LONG = 1 << 63


def usable_vectors(table: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, vector) of the rows that take part, the vector as doubles."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(1 << 62)))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & whole)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("vector") == F.lit(sizes[0] if sizes else 0))


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(key, x): the entries as longs, written once."""
    x = F.transform("vector", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))
    return freeze(rows.select("key", x.alias("x")), "whole_numbers")


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded slices of the batches with their x-vectors as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Fit:
    """Count and exact sums of the fit list; vectors are taken relative to ``base``, whole numbers next to the mean."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.width = len(self.sums)
        self.base = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64) if self.n else np.zeros(0, np.int64)
        self.rest = [s - self.n * int(b) for s, b in zip(self.sums, self.base)]
        self.offset = np.array([r / self.n for r in self.rest]) if self.n else np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without the loss of digits that large sums would bring."""
        return (x - self.base).astype(np.float64) - self.offset

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2 for each row, exactly."""
        near = x - self.base
        far = int(np.abs(near).max(initial=0)) * self.n + self.n
        if far * far * max(1, self.width) < LONG:
            scaled = near * self.n - np.array(self.rest, dtype=np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        return [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in near]


def summed(rows: DataFrame, width: int, columns: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``partial(x-vectors)`` (a matrix of ``columns`` columns) over all rows, added up by matrix row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, width):
            now = partial(x)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))],
                                             ["i", *(f"c{j}" for j in range(columns))])

    names = [f"c{j}" for j in range(columns)]
    parts = rows.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toPandas().sort_values("i")
    return found[names].to_numpy(dtype=np.float64)


def exact_sums(rows: DataFrame, width: int) -> Fit:
    """Count and exact sums per dimension, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, x in matrices(batches, width):
            n += len(x)
            small = int(np.abs(x).max(initial=0)) < LONG // STEP
            total = [t + int(v) for t, v in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(total, pa.decimal128(38, 0))], ["i", "n", "s"])

    parts = rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = sorted((r.i, r.n, int(r.s)) for r in parts.collect())
    return Fit(found[0][1] if found else 0, [s for _, _, s in found])


def lower_bound(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 12) -> float:
    """A bound below the spectrum: the least Ritz value of a short Lanczos run, less the run's last residual."""
    kept, diagonal, beside = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        image = apply(kept[-1][:, None])[:, 0]
        diagonal.append(float(image @ kept[-1]))
        for q in kept * 2:  # twice, since rounding loses what once leaves over
            image = image - (image @ q) * q
        beside.append(float(np.linalg.norm(image)))
        if beside[-1] <= 1e-12 * max(1e-300, max(map(abs, diagonal))):
            break
        kept.append(image / beside[-1])
    small = np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(small)[0]) - beside[-1])


def filtered(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` for the interval (low, cut), scaled to one near ``top``, applied to ``block``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = half / (top - middle)
    scale, before = first, block
    now = (apply(block) - middle * block) * (scale / half)
    for _ in range(1, degree):
        after = 1 / (2 / first - scale)
        before, now = now, (apply(now) - middle * now) * (2 * after / half) - scale * after * before
        scale = after
    return now


def leading(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD, degree: int = DEGREE,
            tolerance: float = TOLERANCE, worst: float = WORST, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, their unit vectors (columns), and the largest residual over the largest value."""
    rng = np.random.default_rng(seed)
    size = min(width, wanted + guard)
    low = lower_bound(apply, rng.normal(size=width)) if size < width else 0.0
    block, best = np.linalg.qr(rng.normal(size=(width, size)))[0], None
    for _ in range(MOST_ROUNDS):
        image = apply(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = max(float(values[0]), 0.0)
        wrong = float(np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max())
        share = wrong / top if top > 0 else 0.0
        if share <= tolerance or (best is not None and share < worst and share > best[2] / 2):  # certified, or at rounding
            return best if best is not None and best[2] < share else (values[:wanted], block[:, :wanted], share)
        if best is None or share < best[2]:
            best = (values[:wanted], block[:, :wanted], share)
        cut = float(values[-1])
        low = min(low, cut)
        if size == width or cut - low <= 1e-12 * top or top - cut <= 1e-12 * top:
            block = np.linalg.qr(image)[0] if size < width else block  # nothing to damp: a plain step
        else:
            block = np.linalg.qr(filtered(apply, block, degree, low, cut, top))[0]
    raise ArithmeticError(f"not certified after {MOST_ROUNDS} rounds; the residual is {best[2]:.3g} of the largest eigenvalue")


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, **options) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), one row for each row taking part and component.

    ``deviation`` is a decimal (null beyond 38 digits); ``identity_error`` is the largest absolute entry of the whitened
    values' covariance minus the identity, over the components that have variance, from a pass of its own.
    """
    spark = table.sparkSession
    rows = whole_numbers(usable_vectors(table, vector, key))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T._parse_datatype_string(
        "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    first = rows.select(F.size("x")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    fit = exact_sums(rows, first[0])
    width, n = fit.width, fit.n

    def apply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            own = fit.centred(x)
            return own.T @ (own @ block)

        return summed(rows, width, block.shape[1], part) / n

    values, vectors, _ = leading(apply, width, min(components, width), **options)
    spread = summed(rows, width, 1, lambda x: (fit.centred(x) ** 2).sum(axis=0)[:, None])[:, 0] / n
    trace = float(spread.sum())
    alive = values > max(values[0], 0.0) * 1e-13
    project = vectors[:, alive] / np.sqrt(values[alive])
    error = None
    if alive.any():
        def second(x: np.ndarray) -> np.ndarray:
            own = fit.centred(x) @ project
            return np.concatenate([own.T @ own, own.sum(axis=0)[None, :]])

        moments = summed(rows, width, project.shape[1], second) / n
        error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(project.shape[1])).max())
    explained = (values / trace).tolist() if trace > 0 else [None] * len(values)
    count, place = len(values), np.cumsum(alive) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, width):
            m = len(x)
            own = np.full((m, count), np.nan)
            own[:, alive] = (fit.centred(x) @ project)[:, place[alive]]
            apart = [d if d < 10**38 else None for d in fit.deviations(x)]
            take = pa.array(np.repeat(np.arange(m), count))
            yield pa.RecordBatch.from_arrays([
                part.column("key").take(take), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n, dtype=np.int64)), pa.array(apart, pa.decimal128(38, 0)).take(take),
                pa.array(own.ravel(), mask=np.tile(~alive, m)), pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * count), pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
