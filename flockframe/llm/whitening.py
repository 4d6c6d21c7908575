"""Whitening components of vectors by shifted Cholesky QR.

The different vectors, made whole numbers, are the rows of a tall matrix A. A pass over them adds up the Gram matrix of A
times the inverse of the triangular factor so far, each task for its rows by triangular solves; the Gram matrix's Cholesky
factor is the next one. The first passes shift the Gram matrix, so its factor exists however
ill-conditioned A is; each pass makes the rows' columns more orthogonal, and the product of the factors is A's own R.
The singular values and right vectors of that small R are A's, found without squaring its condition number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from . import text as X

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Whole entries beyond this have no exact sums any more.
LARGEST = 1 << 52
#: Passes at most, departure from orthogonality that ends them, and singular values that count as nothing.
PASSES, ORTHOGONAL, NOTHING = 10, 1e-11, 1e-13
ROWS = 4096


def _whole(rows, dimensions: int):
    """(which rows count, their entries as whole numbers less SHIFT) of a batch with a list column ``v`` of doubles."""
    lists = rows.column("v")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(flat.reshape(-1, dimensions) * SCALE) if len(flat) else np.zeros((0, dimensions))
    return values.astype(np.int64)


_CODED = pa.schema([("code", pa.binary())])


def _code(dimensions: int):
    """Entries of a row as numbers of the least width of 1, 2, 4 or 8 bytes that holds them all."""
    def run(batches):
        for rows in batches:
            values = _whole(rows, dimensions)
            top = np.maximum(values, -1 - values).max(axis=1, initial=0)
            width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
            out = np.empty(len(values), object)
            for w in np.unique(width):
                out[width == w] = [r.tobytes() for r in values[width == w].astype(f"<i{w}")]
            yield pa.record_batch([pa.array(out, pa.binary())], schema=_CODED)
    return run


def _decoded(batches, dimensions: int):
    for rows in batches:
        codes = rows.column("code").to_pylist()
        for at in range(0, len(codes), ROWS):
            some = codes[at:at + ROWS]
            out = np.empty((len(some), dimensions), np.int64)
            for k, c in enumerate(some):
                out[k] = np.frombuffer(c, f"<i{len(c) // dimensions}")
            yield out


_SUMS = pa.schema([("dimension", pa.int32()), ("n", pa.int64()), ("s", pa.string())])


def _sum(dimensions: int):
    def run(batches):
        n, sums = 0, [0] * dimensions
        for values in _decoded(batches, dimensions):
            n += len(values)
            high, low = values >> 26, values & ((1 << 26) - 1)  # sums of halves stay exact
            sums = [s + (int(a) << 26) + int(b) for s, a, b in zip(sums, high.sum(0), low.sum(0))]
        if n:
            yield X.out(_SUMS, dimension=range(dimensions), n=[n] * dimensions, s=[str(s) for s in sums])
    return run


def _exact(values: np.ndarray, n: int, sums: list[int]):
    """n * x - S of each entry, exact: in 64 bits where that fits, else in Python's own numbers."""
    most = int(np.abs(values).max(initial=0))
    if n * most + max(map(abs, sums)) < 1 << 63:
        return n * values - np.array(sums, np.int64)
    return n * values.astype(object) - np.array(sums, object)


def _centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    exact = _exact(values, n, sums)
    return (exact / n).astype(np.float64)


_GRAM = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("g", pa.float64())])


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, by forward substitution column after column."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _gram(dimensions: int, n: int, sums: list[int], last):
    """Upper half of one task's Gram matrix of its rows after ``last``, and the columns' sums as row -1."""
    def run(batches):
        total, columns = 0, 0
        for values in _decoded(batches, dimensions):
            q = last(_centred(values, n, sums))
            total, columns = total + q.T @ q, columns + q.sum(0)
        if not isinstance(total, int):
            i, j = np.triu_indices(len(total))
            m = len(columns)
            yield X.out(_GRAM, i=np.concatenate((i, np.full(m, -1))), j=np.concatenate((j, np.arange(m))),
                        g=np.concatenate((total[i, j], columns)))
    return run


def _gathered(fit: DataFrame, dimensions: int, n: int, sums: list[int], last, size: int):
    """Gram matrix and column sums over all rows: dimensions squared numbers, added up by Spark."""
    parts = fit.mapInArrow(_gram(dimensions, n, sums, last), "i int, j int, g double")
    gram, columns = np.zeros((size, size)), np.zeros(size)
    for i, j, g in parts.groupBy("i", "j").agg(F.sum("g")).collect():
        if i < 0:
            columns[j] = g
        else:
            gram[i, j] = gram[j, i] = g
    return gram, columns


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor, the shift grown until there is one."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(2 * shift, np.finfo(float).eps * max(np.trace(gram), np.finfo(float).tiny))


def components(fit: DataFrame, dimensions: int, n: int, sums: list[int]):
    """(eigenvectors as columns, eigenvalues) of the covariance, falling, without those that are nothing.

    ``fit`` has the rows' codes. Constant dimensions are left out of the factors and are zero in all vectors.
    """
    eps = np.finfo(float).eps
    gram, _ = _gathered(fit, dimensions, n, sums, lambda a: a, dimensions)
    kept = np.flatnonzero(np.diag(gram) > 0)
    if not len(kept):
        return np.zeros((dimensions, 0)), np.zeros(0)
    d = len(kept)
    gram, factors, whole = gram[np.ix_(kept, kept)], [], np.eye(d)
    for _ in range(PASSES):
        u, s, vt = np.linalg.svd(whole) if factors else (np.eye(d), np.ones(d), np.eye(d))
        live = s > s[0] * NOTHING if factors else np.ones(d, bool)
        if factors and np.abs(u[:, live].T @ gram @ u[:, live] - np.eye(live.sum())).max() <= ORTHOGONAL:
            break
        least = np.linalg.eigvalsh(gram)[0]
        # a Gram matrix near the identity needs no shift
        shift = 0.0 if least > 0.5 else 11 * (d * min(n, 1 << 20) + d * (d + 1)) * eps * np.linalg.norm(gram, 2)
        factors.append(_factor(gram, shift))
        whole = factors[-1] @ whole
        gram, _ = _gathered(fit, dimensions, n, sums, lambda a: _solved(a[:, kept], factors), d)
    _, s, vt = np.linalg.svd(whole)
    live = s > s[0] * NOTHING
    vectors = np.zeros((dimensions, int(live.sum())))
    vectors[kept] = vt[live].T
    return vectors, s[live] ** 2 / n


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _project(dimensions: int, n: int, sums: list[int], projection: np.ndarray, explained, error: float):
    k = projection.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                values = _whole(rows, dimensions)
                exact = _exact(values, n, sums)
                if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * dimensions < 1 << 63:
                    deviation = (exact * exact).sum(1).tolist()
                else:  # beyond 64 bits: null
                    deviation = [s if s < 1 << 63 else None for s in ((r * r).sum() for r in exact.astype(object))]
                white = (exact / n).astype(np.float64) @ projection
                yield X.out(_OUT, vec_id=np.repeat(rows.column("vec_id").to_numpy(zero_copy_only=False), k) if not rows.column("vec_id").null_count
                            else [v for v in rows.column("vec_id").to_pylist() for _ in range(k)],
                            component=np.tile(np.arange(1, k + 1, dtype=np.int32), len(values)), n=np.full(k * len(values), n),
                            deviation=[v for v in deviation for _ in range(k)], whitened=white.ravel(),
                            explained=np.tile(explained, len(values)), identity_error=np.full(k * len(values), error))
    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows whose vector is neither null nor empty, holds no null or non-finite entry and none too large to be a
    whole number after scaling, and is as long as most such vectors (of equally many: the shorter)."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= LARGEST))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter("v is not null and size(v) > 0").filter(~bad)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (length["d"] if length else -1))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each usable row (see ``usable``) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c counts as x = floor(64 c) + 1000000. The components are those of the n different x-vectors, each taken once:
    ``deviation`` is the sum over dimensions of (n x - S)^2, S being their sums (null where it exceeds 64 bits), ``whitened`` the
    centred vector along the component in units of its deviation, ``explained`` the component's share of all variance,
    ``identity_error`` the largest departure of the whitened fit vectors' covariance from the identity.

    Components without variance have no whitened values and no rows; so there are fewer than ``most`` where dimensions are
    constant or depend on each other, and none for a single different vector or an empty table. Equal vectors get
    equal values, and repeated rows and null ids rows of their own. Equal eigenvalues leave the choice of vectors
    among them free. Other columns are not looked at.

    Only sums of ``dimensions`` squared numbers come to the driver, one Gram matrix a pass. Equal vectors are combined before
    they are shuffled.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    first = rows.select(F.size("v").alias("d")).first()
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not first:
        return empty
    d = first["d"]
    fit = checkpoint(rows.select("v").mapInArrow(_code(d), "code binary").distinct())
    found = (fit.mapInArrow(_sum(d), "dimension int, n long, s string").groupBy("dimension")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dimension").collect())
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    directions, variances = components(fit, d, n, sums)
    if not len(variances):
        return empty
    k = min(most, len(variances))
    projection = directions[:, :k] / np.sqrt(variances[:k])
    gram, columns = _gathered(fit, d, n, sums, lambda a: a @ projection, k)
    error = float(np.abs(gram / n - np.outer(columns, columns) / n ** 2 - np.eye(k)).max())
    explained = variances[:k] / variances.sum()
    return rows.mapInArrow(_project(d, n, sums, projection, explained, error),
                           "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
