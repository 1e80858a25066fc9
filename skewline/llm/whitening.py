"""Embedding whitening by polarisation of exact variances.

Entries become whole numbers x.  Spark sums the squares of every centred dimension and of
the sum of every two dimensions, exactly; since var(a + b) = var(a) + var(b) + 2 cov(a, b),
differences of these variances give all covariances, and ``eigh`` the components.

Centring is exact too: with y = x - floor(S / n) and R = sum(y), n x - S = n y - R, so the sum
of (n x - S)^2 is n (n sum(y^2) - R^2); y stays small whatever the offset of x, and tasks
return sums of y^2 as decimals of 38 digits.  The driver holds about dim^2 / 2 of them.

Defined results: a vector that is null, empty or holds a null or non-finite entry gives no
rows; entries are clipped at 2^40 times 64; vectors of another length are whitened with those
of their length; a null vec_id is kept; repeated rows count as often as they occur; components
without variance (beyond the rank, so all of them where every vector is equal) are left out;
an empty table gives no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.llm.common import Scratch

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 46)
ROWS_AT_ONCE = 4096
_DECIMAL = pa.decimal128(38, 0)


def whole_vectors(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, dim and x of every usable vector."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            column = column.filter(column.is_valid()) if column.null_count else column
            ids = batch.column(0).filter(batch.column(1).is_valid())
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets -= offsets[0]
            value = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy()
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            size = np.diff(offsets)
            keep = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
            x = np.floor(np.clip(np.nan_to_num(value) * scale, -LARGEST, LARGEST)).astype(np.int64) + offset
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([ids.filter(mask), pa.array(size[keep].astype(np.int32)), lists.filter(mask)],
                                             names=["vec_id", "dim", "x"])

    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .mapInArrow(tasks, "vec_id long, dim int, x array<long>"))


def matrices(batch: pa.RecordBatch, rows: int = ROWS_AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, x as a matrix, rows of the batch) for the vectors of each length, in slices."""
    dims = batch.column(1).to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        for k in range(0, len(at), rows):
            part = at[k:k + rows]
            yield d, batch.column(2).take(pa.array(part)).flatten().to_numpy().reshape(-1, d), part


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Exact column sums of whole numbers, as Python integers."""
    most = max(1, int(np.abs(x).max(initial=0)))
    step = max(1, (1 << 62) // most)
    out = np.zeros(x.shape[1], object)
    for at in range(0, len(x), step):
        out += x[at:at + step].sum(0).astype(object)
    return out


def square_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums of (y_i + y_j)^2 for i < j, and of y_i^2 for i = j, as a flat upper triangle."""
    if int(np.abs(y).max(initial=0)) >= 1 << 29:
        y = y.astype(object)
    d, out = y.shape[1], []
    for i in range(d):
        pair = y[:, i:] + y[:, i:i + 1]
        pair[:, 0] = y[:, i]
        square = pair * pair
        out.append(exact_sum(square) if square.dtype != object else square.sum(0))
    return np.concatenate(out)


def gather(x: DataFrame, totals: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """n and the sums over all vectors of ``totals(matrix, dim)``, for each length: one row a
    total and task, added up by Spark."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for d, m, _ in matrices(batch):
                n, total = sums.get(d, (0, 0))
                sums[d] = n + len(m), total + totals(m, d)
        for d, (n, total) in sums.items():
            k = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()),
                 pa.array([int(t) for t in total], _DECIMAL)], names=["dim", "place", "n", "total"])

    rows = (x.mapInArrow(tasks, "dim int, place int, n long, total decimal(38,0)").groupBy("dim", "place")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim", "place").collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.total))
    return out


class Whitener:
    """Components of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], squares: list[int], components: int):
        d = len(sums)
        self.n = n
        self.centre = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        place = np.zeros((d, d), np.int64)
        place[np.triu_indices(d)] = np.arange(len(squares))

        def variance(i: int, j: int) -> int:
            """n^2 times the variance of dimension i, or of the sum of two dimensions."""
            r = self.rest[i] + (self.rest[j] if j != i else 0)
            return n * squares[place[i, j]] - r * r

        single = [variance(i, i) for i in range(d)]
        v = np.zeros((d, d))
        for i in range(d):
            v[i, i] = single[i] / (n * n)
            for j in range(i + 1, d):
                v[i, j] = v[j, i] = (variance(i, j) - single[i] - single[j]) / (2 * n * n)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        keep = e[:components] > d * np.finfo(float).eps * max(e[0], 0)
        self.values, self.vectors = e[:components][keep], u[:, :components][:, keep]
        self.explained = self.values / (sum(single) / (n * n)) if keep.any() else self.values
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(float) / self.n @ self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        y = x - self.centre
        if (int(np.abs(y).max(initial=0)) + 1) * self.n >= 1 << 62:
            y = y.astype(object)
        return y * self.n - np.array(self.rest, y.dtype)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums over dimensions of (n x - S)^2."""
        t = self.centred(x)
        if t.dtype != object and int(np.abs(t).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return pa.array((t * t).sum(1)).cast(_DECIMAL)
        t = t.astype(object)
        return pa.array([int(s) for s in (t * t).sum(1)], _DECIMAL)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each length of vector."""
    sums = gather(x, lambda m, d: exact_sum(m))
    centres = {d: np.array([s // n for s in total], np.int64) for d, (n, total) in sums.items()}
    squares = gather(x, lambda m, d: square_sums(m - centres[d]))
    return {d: Whitener(n, total, squares[d][1], components) for d, (n, total) in sums.items()}


def identity_errors(x: DataFrame, model: dict[int, Whitener]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, m, _ in matrices(batch):
                w = model[d].whiten(m)
                w1 = np.concatenate([np.ones((len(w), 1)), w], 1)
                sums[d] = sums.get(d, 0) + w1.T @ w1
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel())],
                                             names=["dim", "place", "total"])

    rows = (x.mapInArrow(tasks, "dim int, place int, total double").groupBy("dim", "place").agg(F.sum("total").alias("total"))
            .orderBy("dim", "place").collect())
    totals: dict[int, list[float]] = {}
    for r in rows:
        totals.setdefault(r.dim, []).append(r.total)
    out = {}
    for d, flat in totals.items():
        k = len(model[d].values) + 1
        s = np.array(flat).reshape(k, k) / model[d].n
        cov = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:])
        out[d] = float(np.abs(cov - np.eye(k - 1)).max(initial=0.0))
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error and dim:
    a row for every usable vector and component."""
    x = Scratch(embeddings.sparkSession, "whitening").store(whole_vectors(embeddings))
    model = fit(x, components)
    for d, error in identity_errors(x, model).items():
        model[d].identity_error = error

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, m, at in matrices(batch):
                w = model[d]
                k, size = len(w.values), len(m)
                if not k:
                    continue
                again = pa.array(np.repeat(np.arange(size), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                     pa.array(np.full(size * k, w.n)), w.deviation(m).take(again), pa.array(w.whiten(m).ravel()),
                     pa.array(np.tile(w.explained, size)), pa.array(np.full(size * k, w.identity_error)), pa.array(np.full(size * k, d, np.int32))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "dim"])

    return x.mapInArrow(tasks, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
                               "identity_error double, dim int")


def as_long(value: Column) -> Column:
    """A whole decimal as long, null beyond the range of one."""
    return F.when(F.abs(value) <= F.lit((1 << 63) - 1), value).cast("long")
