"""Whitening of vectors by principal components that LOBPCG finds.

Vectors are centred exactly: with n of them and sums S, a deviation n*x - S is a whole number, and only its quotient by n
is rounded. The covariance is never formed. One pass over the centred rows Z multiplies it by a block W of few columns,
as Z'(Z W)/n, each task adding up its own rows. Rounds search the span of the block of iterates, of their residuals and of
the last step: its orthonormal basis is made on the driver (three blocks of a vector's length at most), the product with
the new directions comes from one pass, and the Rayleigh-Ritz step rotates the basis. A block is wider than what is asked
for, so that a cluster of eigenvalues at the cut doesn't slow it.

Rounds end when every residual |V u - e u|, of a product made afresh, is below ``tolerance`` times the largest eigenvalue,
or at the level of rounding; a residual above CERTIFIED is an error, never a silent result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import frugal, gathered, ship_package
from docloom.llm._vectors import ROWS, finite, matrix, summed

#: Columns that a block has beyond the components asked for.
GUARD = 8
#: Residuals of a result, and the least eigenvalue of a component, both as shares of the largest eigenvalue.
CERTIFIED, RANK = 1e-11, 1e-10
#: A scaled entry's largest magnitude.
LARGEST = 1 << 45
MOMENTS = "length int, at int, value decimal(38,0)"
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Deviations:
    """What tasks need to know: the vectors' length, count and exact sums; ``scale`` makes whole numbers of entries."""

    def __init__(self, length: int, n: int, sums: list[int], most: int, scale: int) -> None:
        self.length, self.n, self.sums, self.scale = length, n, sums, scale
        #: What n*x - S can't exceed.
        self.reach = n * most + max((abs(s) for s in sums), default=0)

    def of(self, column: pa.Array) -> np.ndarray:
        """n*x - S of a batch, whole numbers. The shift of x cancels, so it isn't added first."""
        y = np.floor(matrix(column, self.length).astype(np.float64) * self.scale).astype(np.int64)
        if self.reach < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, column: pa.Array) -> np.ndarray:
        return self.of(column).astype(np.float64) / self.n

    def squares(self, d: np.ndarray) -> list[Decimal]:
        """The exact sum of squares of each row of deviations."""
        if self.length * self.reach * self.reach >= 1 << 63:
            d = d.astype(object)
        return [Decimal(int(s)) for s in (d * d).sum(axis=1)]


class Centred:
    """Rows (id, vector) of one length, and passes over them."""

    def __init__(self, rows: DataFrame, deviations: Deviations) -> None:
        self.rows, self.deviations = rows, deviations

    def mean(self, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The mean over all vectors of ``size`` doubles that ``add`` sums over the centred rows of a batch."""
        deviations = self.deviations
        return summed(self.rows.select("vector"), size, lambda b: add(deviations.centred(b.column(0)))) / deviations.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block, in one pass."""
        return self.mean(block.size, lambda z: (z.T @ (z @ block)).reshape(-1)).reshape(block.shape)

    def trace(self) -> float:
        return float(self.mean(1, lambda z: np.array([(z * z).sum()]))[0])


def centred(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> Centred | None:
    """The vectors without null and non-finite entries, of the commonest length (ties: the longer); None if there are none."""
    v = F.col(vector_col)
    rows = vectors.where(finite(v)).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in gathered(batches, ROWS):
            column = b.column(0)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for k in np.unique(lengths).tolist():
                y = np.floor(matrix(column.filter(pa.array(lengths == k)), k).astype(np.float64) * scale)
                if k and np.abs(y).max() > LARGEST:
                    raise ValueError("a scaled entry is beyond 2**45")
                y = y.astype(np.int64)
                n, most, sums = held.get(k, (0, 0, [0] * k))
                held[k] = [n + len(y), max(most, int(np.abs(y).max(initial=0))), [s + t for s, t in zip(sums, y.sum(axis=0).tolist(), strict=True)]]
        for k, (n, most, sums) in held.items():
            values = [n, most, *sums]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), pa.array(np.arange(-2, k, dtype=np.int32)), pa.array(list(map(Decimal, values)), pa.decimal128(38, 0))], names=["length", "at", "value"])

    parts = rows.select("vector").mapInArrow(frugal(run), MOMENTS)
    # places -2, -1 and from 0 on: the count, the largest magnitude, the sums
    total = F.when(F.col("at") == -1, F.max("value")).otherwise(F.sum("value")).cast("decimal(38,0)").alias("value")
    found = parts.groupBy("length", "at").agg(total)
    counts = {r.length: int(r.value) for r in found.where("at = -2").orderBy(F.desc("value"), F.desc("length")).limit(1).collect()}
    if not counts or not next(iter(counts)):
        return None
    length, n = next(iter(counts.items()))
    values = {r["at"]: int(r.value) for r in found.where(F.col("length") == length).collect()}
    return Centred(rows.where(F.size("vector") == length), Deviations(length, n, [values[i] for i in range(length)], values[-1], scale))


def new_directions(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the span of ``basis``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8][:, : basis.shape[0] - basis.shape[1]]
    u = np.linalg.qr(u - basis @ (basis.T @ u))[0] if u.size else u
    return u


def leading_components(data: Centred, k: int, tolerance: float = 1e-14, most_rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of the covariance, their unit eigenvectors (columns; the largest entry is positive), the
    residuals and the number of rounds."""
    d = data.deviations.length
    m = min(d, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax = data.times(x)
    step = np.zeros((d, 0))
    last = np.inf
    for rounds in range(1, most_rounds + 1):
        e, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax, e = x @ c[:, ::-1], ax @ c[:, ::-1], e[::-1]
        residuals = ax - x * e
        size = np.linalg.norm(residuals[:, :k], axis=0).max(initial=0.0)
        top = max(float(e[0]), 0.0)
        # a product made afresh: rotations of earlier products carry their rounding along
        if size <= tolerance * top or size >= last / 2 and size <= CERTIFIED * top:
            x = np.linalg.qr(x)[0]
            ax = data.times(x)
            e = np.einsum("ij,ij->j", x, ax)
            size = np.linalg.norm((ax - x * e)[:, :k], axis=0)
            if size.max(initial=0.0) <= CERTIFIED * top:
                order = np.argsort(-e[:k], kind="stable")
                u, e = x[:, :k][:, order], e[:k][order]
                u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
                return e, u, size[order], rounds
            last = np.inf
            residuals = ax - x * e
        else:
            last = size
        w = new_directions(x, residuals)
        q = np.column_stack([x, w])
        w = np.column_stack([w, new_directions(q, step)])
        if not w.size:
            continue
        q, aq = np.column_stack([x, w]), np.column_stack([ax, data.times(w)])
        _, c = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        c = c[:, ::-1][:, :m]
        x, ax, step = q @ c, aq @ c, w @ c[m:]
    raise ArithmeticError(f"residuals are above {CERTIFIED} after {most_rounds} rounds")


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """WHITENED rows: for each vector and component, numbered from 1 by falling eigenvalue, the vector's centred
    projection over the component's standard deviation, with the vector's exact deviation, the component's share of the
    variance, and the largest entry of the whitened vectors' covariance less the identity, measured over all of them.

    Entries c count as floor(scale * c); a constant added to all of them would cancel everywhere. Vectors that are null or hold null or non-finite entries are left out, as
    are those of another length than the commonest (ties: the longer). There are as many components as ``components``,
    the length and the rank allow: those with less than 1e-10 of the largest eigenvalue can't be scaled to one and aren't
    returned, so vectors that are all equal give no row. Each of repeated rows and null ids has its own rows; other
    columns aren't looked at; an empty table gives an empty result. An entry beyond 2**45 after scaling is an error."""
    spark = vectors.sparkSession
    ship_package(spark)
    data = centred(vectors, id_col, vector_col, scale)
    if data is None:
        return spark.createDataFrame([], WHITENED)
    deviations, trace = data.deviations, data.trace()
    if not trace > 0:
        return spark.createDataFrame([], WHITENED)
    e, u, _, _ = leading_components(data, min(components, deviations.length))
    keep = e > RANK * e[0]
    e, u = e[keep], u[:, keep]
    k, projection = len(e), u / np.sqrt(e)

    def moments_of(z: np.ndarray) -> np.ndarray:
        w = z @ projection
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(axis=0)])

    moments = data.mean(k * k + k, moments_of)
    error = float(np.abs(moments[: k * k].reshape(k, k) - np.outer(moments[k * k :], moments[k * k :]) - np.eye(k)).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                d = deviations.of(part.column(1))
                w = (d.astype(np.float64) / deviations.n) @ projection
                rows = len(d)
                each = lambda c: c.take(pa.array(np.repeat(np.arange(rows), k)))
                squares = pa.array(deviations.squares(d), pa.decimal128(38, 0))
                columns = [each(part.column(0)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, deviations.n)), each(squares), pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WHITENED.split(", ")])

    return data.rows.mapInArrow(frugal(run), WHITENED)
