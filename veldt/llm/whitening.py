"""Whitening of embeddings by spectral divide-and-conquer.

Entries become integers, so the fit list (every distinct vector once), its
sums and its co-moments are exact and do not depend on how Spark deals the
rows: tasks add up integers about the integer nearest to the mean, and the
covariance V is divided out once, on the driver, from width x width totals.

Eigenvectors come from polar decompositions.  For a shift inside the spectrum
the polar factor U of V - shift I is the sign of that matrix, (U + I) / 2
projects on the eigenvectors above the shift, and an orthonormal basis of its
range and of the rest turns V into two smaller blocks, which are split again
until a block is one number (or one number times the identity).  U is found by
the dynamically weighted Halley iteration: QR of the stacked matrix while the
weights are large, Cholesky afterwards; about six steps for any condition.

The few leading components are sent to all tasks and every row is projected.

Defined cases: rows whose vector is null or holds null or non-finite entries
(or entries whose integer is 2^62 or more) are left out; shorter vectors count
as filled up with zeros; repeated rows and null ids stay rows of the result;
components whose eigenvalue is zero to working precision (fewer distinct
vectors than components, say) have a null ``whitened``, and without any
variance ``explained`` is null too; a deviation beyond a long is null; other
columns do not matter; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16

_EPS = float(np.finfo(np.float64).eps)
_WHOLE = pa.decimal128(38, 0)
_FIXED = pa.decimal128(38, 18)


# ------------------------------------------------------------- dense algebra

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps."""
    size = len(a)
    x, low = a / np.linalg.norm(a), _EPS / 2
    for _ in range(20):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        wb = (wa - 1)**2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        else:
            half = np.linalg.inv(np.linalg.cholesky(np.eye(size) + wc * x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * (x @ half.T) @ half
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if 1 - low < 10 * _EPS and moved < np.cbrt(_EPS):
            break
    return x


def _halves(a: np.ndarray, tiny: float) -> tuple[np.ndarray, int] | None:
    """Orthonormal basis whose first columns span the eigenvectors above a shift, and their number."""
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    best = None
    for shift in (float(np.median(np.diag(a))), mean, mean + spread / 3, mean - spread / 3, mean + spread / 7, mean - spread / 7):
        moved = a - shift * np.eye(size)
        if np.linalg.norm(moved) <= tiny:
            continue
        u = polar(moved)
        above = (u + np.eye(size)) / 2
        k = round(float(np.trace(above)))
        if not 0 < k < size:
            continue
        basis = np.random.default_rng(size).normal(size=(size, k))
        for _ in range(2):
            basis, _ = np.linalg.qr(above @ basis)
        basis, _ = np.linalg.qr(basis, mode="complete")
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = left, basis, k
        if left <= tiny:
            break
    return best and best[1:]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    tiny = 8 * len(v) * _EPS * float(np.linalg.norm(v))

    def split(a: np.ndarray) -> np.ndarray:
        size = len(a)
        if size == 1 or np.linalg.norm(a - np.trace(a) / size * np.eye(size)) <= tiny:
            return np.eye(size)
        halves = _halves(a, tiny)
        if halves is None:  # no shift separates the spectrum at working precision
            return np.eye(size)
        basis, k = halves
        parts = []
        for b in (basis[:, :k], basis[:, k:]):
            block = b.T @ a @ b
            parts.append(b @ split((block + block.T) / 2))
        return np.hstack(parts)

    q = split(v)
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    q = q[:, order]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)  # one sign for all runs
    return values[order], q


# ------------------------------------------------------------- exact sums

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y^T y of integers."""
    top = int(np.abs(y).max()) if y.size else 0
    if len(y) * top**2 < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _totals(width: int, centre: np.ndarray | None):
    """(i, j, s) of one task: without a centre the sums (j = -1), with one the co-moments about it (i <= j)."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b.column(0), width)
            one = x.astype(object).sum(axis=0) if centre is None else _products(x - centre)
            total = one if total is None else total + one
        if total is not None:
            i, j = (np.arange(width), np.full(width, -1)) if centre is None else upper
            s = total if centre is None else total[upper]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array([Decimal(int(v)) for v in s], _WHOLE)], names=["i", "j", "s"])

    return run


def _summed(fit: DataFrame, width: int, centre: np.ndarray | None) -> dict:
    tasks = fit.select("x").mapInArrow(_totals(width, centre), "i int, j int, s decimal(38,0)")
    return {(r["i"], r["j"]): int(r["s"]) for r in tasks.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}  # width^2 at most


# ------------------------------------------------------------- projection

class Whitener:
    """Everything that a task needs: n, sums, centre, components."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, v: np.ndarray, components: int):
        self.n, self.sums, self.centre = n, sums, centre
        self.rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
        self.shift = np.array([r / n for r in self.rest])
        values, vectors = eigen(v)
        m = min(components, len(v))
        trace = float(np.trace(v))
        self.values, self.vectors = values[:m], vectors[:, :m]
        self.real = self.values > len(v) * _EPS * max(float(values[0]) if m else 0.0, 0.0)
        self.explained = [float(e) / trace if trace > 0 else None for e in np.maximum(self.values, 0.0)]
        self.project = self.vectors / np.sqrt(np.where(self.real, self.values, 1.0))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.shift) @ self.project

    def deviation(self, x: np.ndarray) -> list:
        """Sum of (n x - S)^2 of every row; None beyond a long."""
        y = x - self.centre
        top = self.n * (int(np.abs(y).max()) if y.size else 0) + max(map(abs, self.rest), default=0)
        if len(self.rest) * top**2 < 2**63:
            return ((self.n * y - np.array(self.rest, np.int64))**2).sum(axis=1).tolist()
        sums = ((self.n * y.astype(object) - np.array(self.rest, object))**2).sum(axis=1)
        return [int(s) if s < 2**63 else None for s in sums]


def _moments(w: Whitener):
    m = int(w.real.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(m), np.zeros((m, m))
        for b in batches:
            z = w.whiten(_matrix(b.column(0), len(w.sums)))[:, w.real]
            one, two = one + z.sum(axis=0), two + z.T @ z
        i, j = np.divmod(np.arange(m * (m + 1)), m)  # row m holds the sums
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array([Decimal(f"{v:.18f}") for v in (*two.ravel(), *one)], _FIXED)], names=["i", "j", "s"])

    return run


def identity_error(fit: DataFrame, w: Whitener) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity (sums in fixed point: the same in every run)."""
    m = int(w.real.sum())
    if not m:
        return None
    got = fit.select("x").mapInArrow(_moments(w), "i int, j int, s decimal(38,18)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((m + 1, m))
    for r in got:
        total[r["i"], r["j"]] = float(r["s"]) / w.n
    return float(np.abs(total[:m] - np.outer(total[m], total[m]) - np.eye(m)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _projected(w: Whitener):
    m = len(w.values)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), len(w.sums))
            row = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), w.n)),
                 pa.array(w.deviation(x), pa.int64()).take(pa.array(row)),
                 pa.array(w.whiten(x).ravel(), mask=np.tile(~w.real, len(x))), pa.array(w.explained * len(x), pa.float64())], schema=schema)

    return run


# ------------------------------------------------------------- operator

def integers(rows: DataFrame, key: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + offset, of the rows that take part."""
    v = F.col("v")
    out = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    out = out.where(v.isNotNull() & F.forall(v, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(2.0**62)))
    return out.select("vec_id", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset).cast("bigint")).alias("x"))


def fit_whitener(fit: DataFrame, n: int, width: int, components: int = COMPONENTS) -> Whitener:
    """``fit``: n distinct vectors x of one width."""
    sums = _summed(fit, width, None)
    sums = [sums[i, -1] for i in range(width)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((width, width))
    for (i, j), s in _summed(fit, width, centre).items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / n**2
    return Whitener(n, sums, centre, v, components)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET, key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    rows = integers(vectors, key, vector, scale, offset)
    sizes = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    width = sizes["most"]
    if not width:  # no rows, or vectors without entries
        return spark.createDataFrame([], f"{_OUT}, identity_error double")
    if sizes["least"] < width:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("bigint"), F.lit(width) - F.size("x"))))
    fit = C.materialize(rows.select("x").distinct(), "fit")
    w = fit_whitener(fit, fit.count(), width, components)
    return rows.select("vec_id", "x").mapInArrow(_projected(w), _OUT).withColumn("identity_error", F.lit(identity_error(fit, w)).cast("double"))
