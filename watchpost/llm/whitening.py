"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X of the fit list are never held together.  A step needs X v (a left
vector) and X' u (the next right vector); one pass over the rows gives both.  A left vector
is in the span of X, so it is kept as the d numbers p with u = X p; the task that computes
r = X q also adds up X' r, and the lengths and inner products of left vectors follow from
those sums: <X p, X q> = p' (X' X q).  Both sides are fully reorthogonalised, twice.  The
bidiagonal matrix of the lengths has the singular values of X; its right vectors, carried
back, are the components.  The driver holds d x d numbers whatever the number of rows.

Where a length vanishes (the rows span fewer dimensions, or equal eigenvalues leave the
space closed), the step starts anew from a vector orthogonal to all before.  All d steps are
taken, so no component can be missed.

Rows: a vector that is null or holds a null or non-finite entry is dropped, and so is one
with an entry of 2**40 or more in size (no exact deviation fits a long then) and one whose
length is zero or not the most frequent length (the longer of two).  Equal vectors count once in the
fit and each keeps its rows.  Components whose eigenvalue is zero are left out, so a fit list
of one vector, or an empty table, gives no rows.  Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

SHIFT, SCALE, LARGEST = 1_000_000, 64, 2.0 ** 40
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Fit:
    """What the components rest on: rows, per-dimension sums, components (a row each), eigenvalues, total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def fixed_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of longs) of the rows that count."""
    own = pick(df, vec_id=id_col, v=vector_col).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    fine = own.where("v IS NOT NULL").where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    fine = fine.where(F.size("v") > 0)
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    fine = fine.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    return fine.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _blocks(vectors: DataFrame) -> DataFrame:
    """The different vectors as blocks of bytes (rows of little-endian longs): a pass copies them without decoding."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_matrix(batch.column("x")))
            size += held[-1].nbytes
            if size >= BLOCK_BYTES:
                yield _packed(np.concatenate(held))
                held, size = [], 0
        if held:
            yield _packed(np.concatenate(held))
    return vectors.select("x").distinct().mapInArrow(pack, "rows long, block binary")


def _packed(x: np.ndarray) -> pa.RecordBatch:
    each = max(1, BLOCK_BYTES // max(8, 8 * x.shape[1]))
    parts = [x[i:i + each] for i in range(0, len(x), each)]
    return pa.RecordBatch.from_pydict({"rows": pa.array([len(p) for p in parts], pa.int64()), "block": pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())})


def _added(blocks: DataFrame, fn, kind: str) -> np.ndarray:
    """Sum over all blocks of ``fn(x)``, a vector of a length that does not depend on the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows, block in zip(batch.column("rows").to_pylist(), batch.column("block")):
                part = fn(np.frombuffer(block.as_buffer(), "<i8").reshape(rows, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "value": pa.array(total)})
    got = blocks.mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(got, key=lambda r: r["at"])], np.int64 if kind == "long" else np.float64)


def _orthogonal(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``w`` less its parts along ``basis``, taken twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            w = w - q.T @ (q @ w)
    return w


def _fresh(rng: np.random.Generator, d: int, basis: list[np.ndarray]) -> np.ndarray:
    w = _orthogonal(rng.standard_normal(d), basis)
    return w / np.linalg.norm(w)


def bidiagonalise(product, d: int, size: float, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Bidiagonal B (upper, d x d) and right vectors V (rows) with X' X = V' B' B V.

    ``product(q)`` returns X' (X q); ``size`` is the root of the trace of X' X.  A length
    below 1e-10 of ``size`` is zero: then B's column ends there and the next right vector
    is drawn afresh.
    """
    rng, tiny = np.random.default_rng(seed), 1e-10 * size
    right, left, images = [], [], []  # v; p with u = X p; X' u
    b = np.zeros((d, d))
    v, beta = _fresh(rng, d, []), 0.0
    for k in range(d):
        right.append(v)
        q = v - beta * left[-1] if beta else v.copy()
        y = product(q)
        for _ in range(2):  # left vectors: <u_j, X q> = p_j' y, and y moves with q
            for j, p in enumerate(left):
                if p is not None:
                    along = float(p @ y)
                    q, y = q - along * p, y - along * images[j]
        alpha = float(np.sqrt(max(0.0, q @ y)))
        if alpha <= tiny:  # X v adds no direction
            left.append(None)
            images.append(None)
            beta = 0.0
        else:
            left.append(q / alpha)
            images.append(y / alpha)
            b[k, k] = alpha
            w = _orthogonal(images[-1] - alpha * v, right)
            beta = float(np.linalg.norm(w))
        if k + 1 < d:
            if beta <= tiny:
                beta, v = 0.0, _fresh(rng, d, right)
            else:
                b[k, k + 1] = beta
                v = w / beta
    return b, np.array(right)


def fit(vectors: DataFrame, components: int = 16, seed: int = 12) -> tuple[Fit | None, DataFrame]:
    """Components of the different vectors, and the written blocks they were fitted on."""
    blocks = written(_blocks(vectors), "vectors")
    totals = _added(blocks, lambda x: np.append(x.sum(0), len(x)), "long")
    if len(totals) < 2:
        return None, blocks
    n, sums = int(totals[-1]), totals[:-1]
    about = Fit(n, sums, np.zeros((0, len(sums))), np.zeros(0), 0.0)
    trace = float(_added(blocks, lambda x: np.array([np.square(about.centred(x)).sum()]), "double")[0])
    if trace == 0:
        return None, blocks

    def product(q: np.ndarray) -> np.ndarray:
        def both(x: np.ndarray) -> np.ndarray:
            rows = about.centred(x)
            return (rows @ q) @ rows
        return _added(blocks, both, "double")
    b, right = bidiagonalise(product, len(sums), trace ** 0.5, seed)
    _, sigma, turn = np.linalg.svd(b)
    some = np.flatnonzero(sigma > 1e-9 * sigma[0])[:components]
    return Fit(n, sums, turn[some] @ right, sigma[some] ** 2 / n, trace / n), blocks


def identity_error(model: Fit, blocks: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.eigenvalues)
    mean = _added(blocks, lambda x: model.whitened(x).sum(0), "double") / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x) - mean
        return (w.T @ w).ravel()
    return float(np.abs(_added(blocks, products, "double").reshape(k, k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; raises where it is no long."""
    apart = n * x - sums
    if len(apart) and float(np.abs(apart).max()) ** 2 * apart.shape[1] >= 2.0 ** 62:
        exact = [sum(int(c) ** 2 for c in row) for row in apart.tolist()]
        if max(exact) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, np.int64)
    return np.square(apart).sum(1)


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 12) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = fixed_vectors(df, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, blocks = fit(vectors, components, seed)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(model, blocks), len(model.eigenvalues)
    share = model.eigenvalues / model.trace

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column("x")), batch.num_rows
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, model.n)), "deviation": pa.array(np.repeat(deviations(x, model.n, model.sums), k)),
                "whitened": pa.array(model.whitened(x).ravel()), "explained": pa.array(np.tile(share, rows)), "identity_error": pa.array(np.full(rows * k, error))})
    return vectors.mapInArrow(score, schema)
