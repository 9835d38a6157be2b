"""Whitening of integer-scaled embeddings by QDWH spectral divide and conquer of their covariance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .vectors import of_common_width, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMIT = float(1 << 34)
_EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations.

    The weights follow a lower bound of the least singular value relative to the largest.  It starts at the
    machine's precision, which holds for any matrix that isn't singular to rounding, and each step raises it
    cubically, so six steps reach full precision.
    """
    x, low = a / np.linalg.norm(a), _EPS
    eye = np.eye(len(x))
    for _ in range(30):
        d = (4 * (1 - low * low) / low**4) ** (1 / 3)
        h = math.sqrt(1 + d) + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * math.sqrt(1 + d)))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, eye]))
        before, x = x, (b / c) * x + (h - b / c) / math.sqrt(c) * (q[: len(x)] @ q[len(x) :].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        if abs(1 - low) < 10 * _EPS and np.linalg.norm(x - before) < (10 * _EPS) ** (1 / 3):
            break
    return x


def _bases(projector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a spectral projector's range and of its complement: one pivoted step of subspace iteration."""
    rank = int(round(float(np.trace(projector))))
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    q, _ = np.linalg.qr(projector[:, order])
    first, _ = np.linalg.qr(projector @ q[:, :rank]) if rank else (q[:, :0], None)
    whole, _ = np.linalg.qr(np.hstack([first, (np.eye(len(projector)) - projector)[:, np.argsort(np.linalg.norm(projector, axis=0), kind="stable")]]))
    return whole[:, :rank], whole[:, rank : len(projector)]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling, by spectral divide and conquer.

    The polar factor U of ``A - s I`` gives the projector (U + I) / 2 on the eigenvectors above s.  Orthonormal
    bases of its range and complement split A into two diagonal blocks, which are split in turn until one
    dimension is left, or a block is a multiple of the identity up to rounding, where any basis will do.  A shift
    that hits an eigenvalue leaves a coupling between the blocks; then another one is taken.
    """
    scale = np.linalg.norm(v)

    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(a)
        a = (a + a.T) / 2
        diagonal = np.diag(a)
        if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= 4 * _EPS * scale:
            return diagonal, np.eye(n)
        best = None
        middle = float(np.median(diagonal))
        spread = max(float(np.ptp(diagonal)), float(np.linalg.norm(a - middle * np.eye(n))) / n)
        for move in (0.0, 0.05, -0.05, 0.15, -0.15, 0.3, -0.3, 0.5, -0.5, 0.8, -0.8):
            shifted = a - (middle + move * spread) * np.eye(n)
            above, below = _bases((polar(shifted) + np.eye(n)) / 2)
            if not above.shape[1] or not below.shape[1]:
                continue
            left = np.linalg.norm(below.T @ a @ above)
            if best is None or left < best[0]:
                best = (left, above, below)
            if left <= 8 * n * _EPS * scale:
                break
        if best is None:  # all eigenvalues on one side of every shift: no gap that rounding can tell
            return diagonal, np.eye(n)
        values, vectors = zip(*[(e, base @ w) for base in best[1:] for e, w in [split(base.T @ a @ base)]], strict=True)
        return np.concatenate(values), np.hstack(vectors)

    if not len(v) or not scale:
        return np.zeros(len(v)), np.eye(len(v))
    _, vectors = split(v)
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def scaled(vector: Column) -> Column:
    """Entries as longs: floor(64 c) + 1000000; entries beyond LIMIT end there, so that sums of products stay in range."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LIMIT)), F.lit(-LIMIT)) * SCALE).cast("long") + SHIFT)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(vectors: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``of(rows of a batch)``, whose size depends on the width alone.

    Partitions send their own sums, entry by entry; these are added by place and no task gets rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in pieces(batches, 4096):
            part = of(_rows(batch, width)).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total))), "value": pa.array(total)})

    parts = vectors.select("x").mapInArrow(run, f"place long, value {kind}")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return np.array([r["value"] for r in found])


class Whitening:
    """Means, covariance and components of all usable vectors; ``apply`` whitens rows by them.

    Counts and sums are exact; the covariance is the mean product of the deviations (n x - S) / n, formed per
    batch and added over the cluster.  The decomposition of the (width x width) covariance is the driver's
    only work.  A component whose eigenvalue is no more than rounding has no whitened values (null).
    """

    def __init__(self, vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS):
        column = F.col(vector)
        fine, self.width = of_common_width(vectors.where(usable(column)), vector)
        self.vector, self.width = vector, max(1, self.width)
        x = fine.select(scaled(column).alias("x"))
        width = self.width
        self.n = x.count()
        self.sums = summed(x, width, lambda m: m.sum(axis=0), "long") if self.n else np.zeros(width, np.int64)
        n, sums = self.n, self.sums
        cov = summed(x, width, lambda m: (c := (n * m - sums) / n).T @ c).reshape(width, width) / n if n else np.zeros((width, width))
        self.trace = float(np.trace(cov))
        self.values, self.axes = (y[..., :components] for y in spectrum(cov))
        self.kept = self.values > width * _EPS * max(self.trace, _EPS)
        roots = np.sqrt(np.where(self.kept, self.values, 1.0))
        weights, self.roots = self.axes / roots, roots
        self.weights = weights
        self.identity_error = None
        if self.kept.any():
            some = weights[:, self.kept]
            got = summed(x, width, lambda m: (w := (n * m - sums) / n @ some).T @ w) / n
            self.identity_error = float(np.abs(got - np.eye(some.shape[1]).ravel()).max())

    def apply(self, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
        """(key, deviation long, whitened array<double>) of each usable row of the fitted width.

        ``deviation`` is the exact sum of (n x - S)^2 over the dimensions, null where it exceeds a long.
        Unusable rows (null, empty or other vectors, null or non-finite entries) are left out; repeated rows and
        null keys stay.
        """
        n, sums, weights, width, kept = self.n, self.sums, self.weights, self.width, self.kept
        column = F.col(self.vector)
        schema = pa.schema([("key", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 4096):
                far = n * _rows(batch, width) - sums
                size = (far.astype(float) ** 2).sum(axis=1)
                exact = (far * far).sum(axis=1)
                whitened = far / n @ weights
                flat = pa.array(whitened.ravel(), mask=np.tile(~kept, len(whitened)))
                offsets = pa.array(np.arange(len(whitened) + 1, dtype=np.int32) * len(kept))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(exact, mask=size > 9.2e18), pa.ListArray.from_arrays(offsets, flat)], schema=schema)

        fine = vectors.where(usable(column) & (F.size(column) == width)).select(F.col(key).cast("long").alias("key"), scaled(column).alias("x"))
        return fine.mapInArrow(run, "key long, deviation long, whitened array<double>").withColumnRenamed("key", key)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors of another length than the most frequent one are no part of the fit and get no rows, like null ones
    and those with null or non-finite entries.  An empty table gives no rows; with a single vector, or equal ones,
    no component has variance: ``whitened``, ``explained`` and ``identity_error`` are null.
    """
    fit = Whitening(vectors, vector, components)
    shares = [float(e / fit.trace) if fit.trace > 0 else None for e in fit.values]
    shares = F.array(*[F.lit(s).cast("double") for s in shares])
    rows = fit.apply(vectors, key).select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        key, (F.col("place") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error"))
