"""Principal axes by randomised subspace iteration: the data is read once a round, and only thin sums meet.

A round multiplies a thin orthonormal matrix (dimensions x axes) by the centred Gramian, which no task ever forms: each task sums
``X' (X Q)`` over its rows, the sums are added by row of the result, and the driver brings it back to orthonormal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS, EXTRA, SEED = 6, 10, 7


def _rows(batch: pa.RecordBatch, vector: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of a batch are usable, their matrix): vectors of ``width`` finite numbers."""
    vectors = batch.column(vector)
    usable = pc.equal(pc.list_value_length(vectors), width).fill_null(False).to_numpy(zero_copy_only=False)
    matrix = vectors.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    finite = np.isfinite(matrix).all(axis=1)
    usable[usable] = finite
    return usable, matrix[finite]


@dataclass
class Axes:
    """``axes`` (dimensions x k), the ``mean`` they start from, and the share of all variance along each."""

    axes: np.ndarray
    mean: np.ndarray
    explained: np.ndarray

    def first(self, k: int | None = None, variance: float | None = None) -> Axes:
        """The first ``k`` axes, or as few as explain ``variance`` (all, if they do not)."""
        if variance is not None:
            k = min(int(np.searchsorted(np.cumsum(self.explained), variance - 1e-12)) + 1, len(self.explained))
        return Axes(self.axes[:, :k], self.mean, self.explained[:k])

    def project(self, df: DataFrame, vector: str, name: str = "projected") -> DataFrame:
        """Rows with their coordinates along the axes; an empty list where the vector is unusable."""
        axes, mean = self.axes, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                usable, matrix = _rows(batch, vector, len(mean))
                flat = (matrix - mean) @ axes
                offsets = np.r_[0, np.cumsum(np.where(usable, axes.shape[1], 0))].astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def _summed(df: DataFrame, vector: str, width: int, columns: int, sums) -> np.ndarray:
    """The sum over all tasks of ``sums(matrix)``, an array of ``columns`` columns, added by row of the array."""
    names = [f"c{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = sums(_rows(batch, vector, width)[1])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, np.ascontiguousarray(total.T))], names=["i", *names])

    partial = df.select(vector).mapInArrow(run, "i long, " + ", ".join(f"{n} double" for n in names))
    # as many rows as the vectors have dimensions, at most
    found = partial.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).orderBy("i").collect()
    return np.array([[r[n] for n in names] for r in found])


def principal_axes(df: DataFrame, vector: str, k: int, rounds: int = ROUNDS, extra: int = EXTRA, seed: int = SEED) -> Axes:
    """The ``k`` axes of greatest variance (fewer, if the vectors have fewer dimensions), greatest first; an axis points to where
    its largest entry is positive. ``extra`` axes are carried along, since the last of them settle slowly. Vectors that are null, empty,
    of an uncommon length, or hold a null or a number that is not finite are left out."""
    width = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if not width:
        return Axes(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    width = width.width
    first = _summed(df, vector, width, 1, lambda x: np.r_[len(x), (x ** 2).sum(), x.sum(axis=0)][:, None])[:, 0]
    if not len(first) or first[0] == 0:
        return Axes(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    n, mean = first[0], first[2:] / first[0]
    total = first[1] - n * (mean ** 2).sum()
    kept = min(k + extra, width)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, kept)))
    for _ in range(1 if kept == width else rounds):
        y = _summed(df, vector, width, kept, lambda x, q=q: (x - mean).T @ ((x - mean) @ q))
        small, before = q.T @ y, q
        q, _ = np.linalg.qr(y)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:min(k, width)]
    axes = before @ turn[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Axes(axes, mean, np.maximum(values[order], 0) / total if total > 0 else np.zeros(len(order)))
