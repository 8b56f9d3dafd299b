"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so counts, sums and every row's deviation from the mean are exact.  A
block of directions is passed through a polynomial of the covariance that stays small on the unwanted
part of the spectrum and grows fast above it.  Each step of the recurrence is one pass over all rows:
a task adds up centred X'(XQ) over its rows, Spark sums the tasks, and the driver holds matrices of
dimensions x block only.  After each polynomial the block is made orthonormal (QR) and turned onto the
eigenvectors within its span (Rayleigh-Ritz); the pass that this takes is the first step of the next
polynomial.  The iteration ends when the residual norms of all wanted directions certify them.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped; rows given twice
count twice; an empty table gives no rows; vectors of different lengths are an error, as is a
deviation beyond 64 bits.  Directions without variance have no whitened value and are left out.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import staged

#: Residual norm, as a share of the largest eigenvalue, at which a direction is certified.
CERTIFIED = 1e-13
#: Residual that is still accepted when rounding lets no more polynomials lower it.
ROUNDING = 1e-11
#: Share of the largest eigenvalue under which a direction has no variance.
FLAT = 1e-12


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`vec_id` and `x`, the entries as whole numbers, of all rows with a finite vector."""
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    made = F.transform(entries, lambda c: F.floor(64 * c).cast("long") + 1_000_000)
    return vectors.where(F.col(vector).isNotNull()).where(finite).select(F.col(vec_id).cast("long").alias("vec_id"), made.alias("x"))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), dims)


def _summed(rows: DataFrame, made, size: int) -> np.ndarray:
    """Sum over all rows of `made(batch)`, an array of `size` numbers."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                found += made(batch).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(found)], ["place", "value"])

    summed = rows.mapInArrow(tasks, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for place, value in summed.collect():
        out[place] = value
    return out


class Moments:
    """Number of rows and sums, exact, and products with the covariance by passes over the rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.dims, widest, self.n = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
        if self.dims != widest:
            raise ValueError(f"vectors have {self.dims} to {widest} entries")
        self.dims = self.dims or 0
        self.sums = np.zeros(self.dims, dtype=np.int64)
        if self.dims:
            entries = rows.select(F.posexplode("x").alias("place", "value"))
            for place, value in entries.groupBy("place").agg(F.sum("value")).collect():
                self.sums[place] = value

    def centred(self):
        """A function of a batch: its rows, the mean taken off before anything is multiplied."""
        n, sums, dims = self.n, self.sums, self.dims
        return lambda batch: (n * _rows(batch, dims) - sums) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times `q`: one pass."""
        centred = self.centred()

        def made(batch: pa.RecordBatch) -> np.ndarray:
            x = centred(batch)
            return x.T @ (x @ q)

        return _summed(self.rows, made, q.size).reshape(q.shape) / self.n

    def trace(self) -> float:
        """Sum of all variances."""
        centred = self.centred()
        return float(_summed(self.rows, lambda batch: np.square(centred(batch)).sum(keepdims=True), 1)[0]) / self.n


def components(
    moments: Moments, count: int, extra: int = 24, degree: int = 12, rounds: int = 200
) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues (falling), their unit eigenvectors as columns, largest relative residual.

    `extra` further directions take part, so that the unwanted spectrum ends below the wanted one.
    """
    dims, trace = moments.dims, moments.trace()
    count = min(count, dims)
    block = min(dims, count + extra)
    q = np.linalg.qr(np.random.default_rng(12).standard_normal((dims, block)))[0]
    last = np.inf
    for _ in range(rounds):
        product = moments.times(q)
        inner = q.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(product - q * values, axis=0)[:count].max() / top if top else 0.0
        if residual <= CERTIFIED or (residual <= ROUNDING and residual > last / 2):
            return values[:count], q[:, :count], residual
        last = residual
        # The unwanted part lies between its least possible value and the last one of the block.
        high = values[-1]
        rest = max(trace - values.sum(), 0.0)
        low = max(0.0, 0.9 * (rest - (dims - block - 1) * high)) if block < dims else 0.0
        if high <= FLAT * top or low >= high:
            low, high = 0.0, max(high, FLAT * top)
        half, middle = (high - low) / 2, (high + low) / 2
        # Scaled by its value at the top eigenvalue, the polynomial neither overflows nor vanishes.
        scale = half / (middle - top)
        first_scale = scale
        before, now = q, (product - middle * q) * (scale / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first_scale - scale)
            step = 2 * (following / half) * (moments.times(now) - middle * now) - scale * following * before
            before, now, scale = now, step, following
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"residual {last} after {rounds} polynomials")


def whitened(
    vectors: DataFrame, count: int = 32, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per finite vector and component: see the columns of the schema below.

    `deviation` is exact; `identity_error` is measured on the whitened values themselves.
    """
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, residual double"
    )
    rows = staged(whole_numbers(vectors, vec_id, vector), "vectors")
    moments = Moments(rows)
    if not moments.n or not moments.dims:
        return rows.sparkSession.createDataFrame([], schema)
    values, directions, residual = components(moments, count)
    some = values > FLAT * values[0]
    values, directions = values[some], directions[:, some]
    n, sums, dims, wanted, trace = moments.n, moments.sums, moments.dims, len(values), moments.trace()
    basis, centred = directions / np.sqrt(values), moments.centred()

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = centred(batch) @ basis
        return np.vstack([z.T @ z, z.sum(axis=0)])

    error = 0.0
    if wanted:
        found = _summed(rows, products, (wanted + 1) * wanted).reshape(wanted + 1, wanted)
        mean = found[-1] / n
        error = float(np.abs(found[:-1] / n - np.outer(mean, mean) - np.eye(wanted)).max())
    shares = values / trace if trace else values

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                exact = n * _rows(part, dims) - sums
                if (np.square(exact.astype(float)).sum(axis=1) >= 2.0**63).any():
                    raise OverflowError("a deviation is beyond 64 bits")
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(len(exact)), wanted))),
                    pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(exact))),
                    pa.array(np.full(len(exact) * wanted, n)),
                    pa.array(np.repeat(np.square(exact).sum(axis=1), wanted)),
                    pa.array(((exact / n) @ basis).ravel()),
                    pa.array(np.tile(shares, len(exact))),
                    pa.array(np.full(len(exact) * wanted, error)),
                    pa.array(np.full(len(exact) * wanted, residual)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(made, schema)
