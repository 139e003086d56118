"""Embedding whitening: principal components of integer vectors, and every
vector projected on them with unit variance.

An entry c becomes the integer x = floor(64 c) + 1000000.  Three passes over the
vectors add up, in Spark, what the fit needs: counts and sums; products of the
vectors centred on the rounded mean (whole numbers, so the sums are exact as
doubles below 2**53, and what rounding the mean leaves over is taken off
exactly); products of the whitened vectors, for the identity error.

The fit has a few numbers a pair of dimensions, whatever the number of vectors,
and runs in one task a vector length: pivoted Cholesky of the centred scatter,
then one-sided Jacobi rotations on the columns of the triangular factor until
they are orthogonal.  Their squared norms are the eigenvalues and the
normalised columns the components.

Defined cases: a vector that is null or holds a null or non-finite entry is
dropped; repeated rows and null ids are rows like others; vectors of another
length are a fit of their own (``LENGTHS`` lengths and ``MODEL_BYTES`` at most, else
ValueError), an empty vector has no components; there are as many components as
the covariance has rank (none for a single vector, or for equal ones);
``deviation`` is null where it exceeds a long; 64 c beyond 2**53 is an error.
An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LENGTHS = 64                    # vector lengths of one table
MODEL_BYTES = 64 << 20          # of all their fits, which every task holds
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as integers) of the vectors of each length that
    take part."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    size = np.diff(start)
    flat = column.values
    entries = flat.to_numpy(zero_copy_only=False)       # nulls become nan
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    good = (bad[start[1:]] == bad[start[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(size[good & (size > 0)]):
        rows = np.flatnonzero(good & (size == n))
        x = np.floor(SCALE * entries[start[rows][:, None] + np.arange(n)])
        if np.abs(x).max() >= 2.0 ** 53:
            raise ValueError("an entry is too large to be counted exactly")
        yield rows, x.astype(np.int64) + SHIFT


def _sums(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = [(x.shape[1], len(x), x.sum(axis=0).tolist()) for _, x in matrices(b.column(1))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                       enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                      ["dim", "n", "sums"])


class Centre:
    """Count and sums of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        near = [(2 * s + n) // (2 * n) for s in sums]                   # the mean, rounded
        self.rest = np.array([s - n * r for s, r in zip(sums, near)])   # what that leaves over, times n
        self.near = np.array(near, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean."""
        return (x - self.near) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sums) squared."""
        z = x - self.near
        top = self.n * int(np.abs(z).max()) + int(np.abs(self.rest).max())
        if x.shape[1] * top ** 2 < 1 << 63:
            return np.square(self.n * z - self.rest).sum(axis=1).tolist()
        out = np.square(self.n * z.astype(object) - self.rest.astype(object)).sum(axis=1)
        return [v if v < 1 << 63 else None for v in out.tolist()]


def _cells(dim: int, products: np.ndarray) -> pa.RecordBatch:
    """The upper triangle of a symmetric matrix as a row."""
    up = products[np.triu_indices(len(products))]
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([up.tolist()], pa.list_(pa.float64()))],
                                      ["dim", "cells"])


def _square(cells: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = cells
    return out + np.triu(out, 1).T


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L^T = a for a positive semidefinite matrix, a column for each unit
    of rank; its rows are in the order of ``a``, and triangular in that of the pivots."""
    a = a.copy()
    d = len(a)
    left = np.ones(d, dtype=bool)
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    columns = []
    for _ in range(d):
        p = int(np.argmax(np.where(left, a.diagonal(), -np.inf)))
        if a[p, p] <= least:
            break
        c = np.where(left, a[:, p], 0.0) / np.sqrt(a[p, p])
        left[p] = False
        a -= np.outer(c, c)
        columns.append(c)
    return np.array(columns).T if columns else np.empty((d, 0))


def one_sided_jacobi(w: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``w``, rotated in pairs until all are orthogonal.  The pairs of
    a round have no column in common, so a round is one step of array operations."""
    w = w.copy()
    r = w.shape[1]
    seats = list(range(r)) + [-1] * (r % 2)
    tolerance = np.finfo(float).eps * np.sqrt(max(len(w), 1))
    for _ in range(sweeps if r > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.array([x for x in zip(seats[: len(seats) // 2], reversed(seats)) if min(x) >= 0]).T
            wp, wq = w[:, p], w[:, q]
            alpha, beta, gamma = (wp * wp).sum(axis=0), (wq * wq).sum(axis=0), (wp * wq).sum(axis=0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if turn.any():
                turned = True
                zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(turn, t, 0.0)
                c = 1 / np.hypot(1.0, t)
                w[:, p], w[:, q] = c * wp - c * t * wq, c * t * wp + c * wq
            seats = [seats[0], seats[-1], *seats[1:-1]]     # everyone but the first moves on a seat
        if not turned:
            break
    return w


def principal(scatter: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, components as rows, trace) of scatter / n, by falling
    eigenvalue; a component's largest entry is positive."""
    w = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((w * w).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:most]
    rows = (w[:, order] / norms[order]).T
    if len(rows):
        top = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
        rows = rows * np.where(top < 0, -1.0, 1.0)[:, None]
    return norms[order] ** 2 / n, rows, float(scatter.diagonal().sum()) / n


class Fit:
    """What whitens the vectors of one length."""

    def __init__(self, centre: Centre, values: np.ndarray, components: np.ndarray, trace: float):
        self.centre, self.components = centre, components
        self.scaled = (components / np.sqrt(values)[:, None]).T
        self.explained = values / trace
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.scaled


def _added(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows (dim, array) of all batches, added up place by place: (dim, pos, total)."""
    rows = common.map_batches(df, fn, schema)
    return rows.select("dim", F.posexplode(rows.columns[-1])).groupBy("dim", "pos").agg(F.sum("col").alias("total"))


def _batches(fn):
    """One output batch of the parts that ``fn`` gives for each length."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [fn(x) for _, x in matrices(b.column(1))]
        parts = [p for p in parts if p is not None]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
    return run


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of ``vectors`` (vec_id, array of double)."""
    sums = common.map_batches(vectors, _sums, "dim int, n long, sums array<long>")
    counts = sums.groupBy("dim").agg(F.sum("n").alias("n")).limit(LENGTHS + 1).collect()
    if len(counts) > LENGTHS or sum(8 * r.dim * (most + 4) for r in counts) > MODEL_BYTES:
        raise ValueError(f"more than {LENGTHS} vector lengths, or {MODEL_BYTES} bytes of fits")
    totals = {r.dim: [0] * r.dim for r in counts}
    for r in _added(vectors, _sums, "dim int, n long, sums array<long>").collect():
        totals[r.dim][r.pos] = r.total
    centres = {r.dim: Centre(r.n, totals[r.dim]) for r in counts}

    def products(x: np.ndarray) -> pa.RecordBatch:
        z = (x - centres[x.shape[1]].near).astype(float)
        return _cells(x.shape[1], z.T @ z)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = int(key[0])
        c = centres[d]
        cells = np.zeros(d * (d + 1) // 2)
        cells[rows["pos"].to_numpy()] = rows["total"].to_numpy()
        rest = c.rest.astype(float)
        values, components, trace = principal(_square(cells, d) - np.outer(rest, rest) / c.n, c.n, most)
        return pd.DataFrame({"dim": d, "value": values, "trace": trace, "vector": pd.Series(list(components), dtype=object)})

    found = (_added(vectors, _batches(products), "dim int, cells array<double>").groupBy("dim")
             .applyInPandas(solve, "dim int, value double, trace double, vector array<double>")).collect()
    fits = {}
    for d in centres:       # sorted again: a task's rows keep no order on their way
        mine = sorted((r for r in found if r.dim == d), key=lambda r: -r.value)
        if mine:
            fits[d] = Fit(centres[d], np.array([r.value for r in mine]), np.array([r.vector for r in mine]), mine[0].trace)

    def white(x: np.ndarray) -> pa.RecordBatch | None:
        f = fits.get(x.shape[1])
        if f is None:
            return None
        w = f.whiten(x)
        w = np.column_stack([np.ones(len(w)), w])       # the first row of the products holds the sums
        return _cells(x.shape[1], w.T @ w)

    cells: dict[int, dict[int, float]] = {}
    for r in _added(vectors, _batches(white), "dim int, cells array<double>").collect():
        cells.setdefault(r.dim, {})[r.pos] = r.total
    for d, f in fits.items():
        k = len(f.components) + 1
        full = _square(np.array([cells[d][i] for i in range(k * (k + 1) // 2)]), k) / f.centre.n
        mean = full[0, 1:]
        f.identity_error = float(np.abs(full[1:, 1:] - np.outer(mean, mean) - np.eye(k - 1)).max())
    return fits


def whitened(df: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component (``SCHEMA``)."""
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    fits = fit(vectors, most)

    def project(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for rows, x in matrices(b.column(1)):
            f = fits.get(x.shape[1])
            if f is None:
                continue
            k, m = len(f.components), len(rows)
            parts.append(pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(rows, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, f.centre.n, dtype=np.int64)),
                pa.array(f.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(f.whiten(x).ravel()), pa.array(np.tile(f.explained, m)),
                pa.array(np.full(m * k, f.identity_error))], [c.split()[0] for c in SCHEMA.split(", ")]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    return common.map_batches(vectors, project, SCHEMA)
