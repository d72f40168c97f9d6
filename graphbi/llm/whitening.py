"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Each entry c of a vector becomes x = floor(64 c) + 1,000,000.  All is computed
on y = floor(64 c): the shift leaves centred values as they are.  A vector is
packed into bytes of the narrowest integer width that holds it; Spark keeps
each packed vector once (the fit list, written as a table), sums its
dimensions exactly and then its centred products.  The covariance, whose size
is the square of the dimension whatever the number of rows, is factored on the
driver:

1. Pivoted Cholesky, P' V P = L L', which ends at V's numerical rank.
2. One-sided Jacobi turns pairs of columns of L until all are orthogonal.
   The squared norms of the columns are then the eigenvalues of V, and the
   normalised columns its eigenvectors.

Defined results: rows whose vector is null, empty, or holds null or
non-finite entries are dropped.  The dimension is the commonest length among
different vectors (the longer of equally common ones); rows of other lengths
are dropped as well.  Values of floor(64 c) beyond 2^60 count as 2^60.  Only
components with a positive eigenvalue (up to V's numerical rank) are returned;
an empty table, or one vector only, has no rows.  ``deviation`` is null where
it exceeds a long.  Repeated rows and null ids each have their results;
further columns are not read.  The sign of a component is that its largest
entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import partition_map, stored, table

#: Scale and offset of the fixed-point entries (fixed values); largest absolute entry without the offset.
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 1 << 60
#: Components returned, at most.
COMPONENTS = 16
#: Rows of a block of output.
_ROWS = 1 << 13


# -- vectors ----------------------------------------------------------------------

def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix of floor(64 c)) of the usable vectors of a batch, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        values = flat[starts[rows, None] + np.arange(n)]
        fine = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(SCALE * values[fine]), -float(LARGEST), float(LARGEST))
        if fine.any():
            yield rows[fine], scaled.astype(np.int64)


def pack(matrix: np.ndarray) -> Iterator[pa.Array]:
    """Rows as bytes: the width of an entry, then the entries; equal rows have equal bytes."""
    most = np.maximum(matrix.max(axis=1), -1 - matrix.min(axis=1))
    widths = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(widths):
        rows = matrix[widths == w]
        body = rows.astype(f"<i{w}").view(np.uint8).reshape(len(rows), -1)
        cells = np.concatenate([np.full((len(rows), 1), w, np.uint8), body], axis=1)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * cells.shape[1]
        yield pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells))])


def unpack(keys: pa.Array) -> np.ndarray:
    """The int64 matrix of packed vectors of one dimension, in some order."""
    data, blocks = {}, []
    for key in keys.to_pylist():
        data.setdefault(key[0], []).append(key[1:])
    for w, rows in data.items():
        blocks.append(np.frombuffer(b"".join(rows), f"<i{w}").reshape(len(rows), -1).astype(np.int64))
    return np.concatenate(blocks)


def fit_list(embeddings: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(key, dim): each different vector once, stored.  Copies are combined before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for _, matrix in _vectors(batch.column(0)):
                for keys in pack(matrix):
                    yield {"key": keys, "dim": pa.array(np.full(len(keys), matrix.shape[1], np.int32))}

    return stored(partition_map(embeddings.select(vector_col), "key binary, dim int", run).distinct(), "llm-whitening")


# -- sums over the fit list -----------------------------------------------------------

def _summed(fit: DataFrame, ddl: str, start, add, rows) -> DataFrame:
    """Sums of what tasks gather: ``add(state, matrix)`` on each block, ``rows(state)`` as (i, j, values) to be summed."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(start() if state is None else state, unpack(batch.column(0)))
        if state is not None:
            yield dict(zip(names, rows(state), strict=True))

    out = partition_map(fit.select("key"), ddl, run)
    return out.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names[2:]))


def dimension_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, exact sum of each dimension); the sums are added up in two halves, which can't overflow."""
    def add(state, m):
        n, high, low = state
        return n + len(m), high + (m >> 31).sum(axis=0), low + (m & (1 << 31) - 1).sum(axis=0)

    got = _summed(fit, "i int, j int, n bigint, high bigint, low bigint", lambda: (0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)), add,
                  lambda s: (np.arange(dim), np.zeros(dim, int), np.full(dim, s[0]), s[1], s[2])).collect()
    sums = [0] * dim
    for r in got:
        sums[r.i] = (r.high << 31) + r.low
    return got[0].n, sums


class Centre:
    """y - S / n to full precision: the nearest whole numbers are taken off exactly, the rest as a fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        whole = [(2 * s + n) // (2 * n) for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = [s - n * w for s, w in zip(sums, whole, strict=True)]  # at most n / 2
        self.fraction = np.array([r / n for r in self.rest])

    def centred(self, m: np.ndarray) -> np.ndarray:
        return (m - self.whole).astype(np.float64) - self.fraction

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """Exact sums of (n y - S)^2 of each row; None beyond a long."""
        off = m - self.whole
        most = self.n * (int(np.abs(off).max()) + 1)
        if most * most * m.shape[1] < 1 << 63:
            return (((self.n * off - np.array(self.rest, np.int64)) ** 2).sum(axis=1)).tolist()
        exact = (sum((self.n * y - r) ** 2 for y, r in zip(row, self.rest, strict=True)) for row in off.tolist())
        return [x if x < 1 << 63 else None for x in exact]


def covariance(fit: DataFrame, width: int, values) -> np.ndarray:
    """Of ``values(matrix)``, already centred, over the fit list; divisor n."""
    upper = np.triu_indices(width)

    def add(state, m):
        z = values(m)
        return state[0] + len(m), state[1] + z.T @ z

    got = _summed(fit, "i int, j int, n bigint, v double", lambda: (0, np.zeros((width, width))), add,
                  lambda s: (upper[0], upper[1], np.full(len(upper[0]), s[0]), s[1][upper])).toPandas()
    out = np.zeros((width, width))
    out[got.i, got.j] = out[got.j, got.i] = got.v / got.n
    return out


def mean(fit: DataFrame, width: int, values) -> np.ndarray:
    got = _summed(fit, "i int, j int, n bigint, v double", lambda: (0, np.zeros(width)), lambda s, m: (s[0] + len(m), s[1] + values(m).sum(axis=0)),
                  lambda s: (np.arange(width), np.zeros(width, int), np.full(width, s[0]), s[1])).toPandas().sort_values("i")
    return (got.v / got.n).to_numpy()


# -- factors ---------------------------------------------------------------------------

def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L' up to rounding, one column for each pivot that counts; the rows stay in v's order."""
    d = len(v)
    left, factor = np.diag(v).astype(float).copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    open_rows = np.ones(d, bool)
    for k in range(d):
        p = int(np.where(open_rows, left, -np.inf).argmax())
        if left[p] <= least:
            return factor[:, :k]
        factor[p, k] = np.sqrt(left[p])
        open_rows[p] = False
        factor[open_rows, k] = (v[open_rows, p] - factor[open_rows, :k] @ factor[p, :k]) / factor[p, k]
        left[open_rows] -= factor[open_rows, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of factor times its transpose.

    A sweep turns each pair of columns once, in rounds of pairs that share no
    column.  It ends when no pair is further from orthogonal than rounding,
    or no longer comes nearer.
    """
    a = factor.copy()
    r = a.shape[1]
    if not r:
        return np.zeros(0), np.zeros((len(a), 0))
    order, last = np.arange(r + r % 2), np.inf
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, off.max(initial=0.0))
            turn = off > np.finfo(float).eps
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            x, y = x[:, turn], y[:, turn]
            a[:, p[turn]], a[:, q[turn]] = c * (x - t * y), c * (t * x + y)
            order = np.r_[order[0], order[-1], order[1:-1]]  # each column meets each other one
        if worst <= 4 * np.finfo(float).eps or (worst < 1e-13 and worst >= last):
            break
        last = worst
    norms = np.sqrt((a * a).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    unit = a[:, by] / norms[by]
    largest = unit[np.abs(unit).argmax(axis=0), np.arange(r)]
    return norms[by] ** 2, unit * np.where(largest < 0, -1.0, 1.0)


# -- operator ----------------------------------------------------------------------------

def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    id_type = embeddings.schema[id_col].dataType.simpleString()
    ddl = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    every = fit_list(embeddings, vector_col)
    most = every.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    if not most:
        return partition_map(rows.limit(0), ddl, lambda batches: iter(()))
    dim = most[0].dim
    fit = every.where(F.col("dim") == dim)
    n, sums = dimension_sums(fit, dim)
    centre = Centre(n, sums)
    v = covariance(fit, dim, centre.centred)
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, len(values))
    if not k:
        return partition_map(rows.limit(0), ddl, lambda batches: iter(()))
    project, explained = vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v)
    shift = mean(fit, k, lambda m: centre.centred(m) @ project)
    identity_error = float(np.abs(covariance(fit, k, lambda m: centre.centred(m) @ project - shift) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for numbers, matrix in _vectors(batch.column("vector")):
                if matrix.shape[1] != dim:
                    continue
                ids = batch.column("vec_id").take(pa.array(numbers))
                for a in range(0, len(matrix), _ROWS):
                    m = matrix[a:a + _ROWS]
                    each = pa.array(np.repeat(np.arange(len(m)), k))
                    yield {"vec_id": ids.slice(a, len(m)).take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                           "n": pa.array(np.full(len(m) * k, n, np.int64)), "deviation": pa.array(centre.deviations(m), pa.int64()).take(each),
                           "whitened": pa.array((centre.centred(m) @ project).ravel()), "explained": pa.array(np.tile(explained, len(m))),
                           "identity_error": pa.array(np.full(len(m) * k, identity_error))}

    return partition_map(rows, ddl, run)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened values of all usable embeddings, up to 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
