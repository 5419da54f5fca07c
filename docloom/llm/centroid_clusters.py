"""Lloyd clustering of integer vectors with Hamerly's two bounds.

Each vector keeps its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to the
second nearest one. When centroids move, the upper bound grows by the drift of the vector's own centroid and the lower one
shrinks by the largest drift of the others. A vector whose upper bound stays below its lower bound, or below half the way
from its centroid to the next one, can't change cluster; its upper bound is first replaced by the true distance where that
helps. All others are compared with every centroid, in exact integers. Bounds are rounded outwards, so they decide work
and never a result.

Vectors and bounds of a round are written to the shared folder, and the round before is deleted then; a round reads them
once to assign and once to add up, without a shuffle of vectors. Centroids and their sums (k times the vector's length)
are all that goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import frugal, gathered, remove, ship_package, staged
from docloom.llm._vectors import ROWS, finite, matrix

#: A scaled component's largest magnitude: distances fit in 63 bits then.
LARGEST = 1 << 27
#: What bounds are widened by, relatively.
SLACK = 1e-12
STATE = "id long, x array<int>, cluster int, upper double, lower double, distance long, scanned boolean"


def square_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows by centroids), exact: in doubles where all sums are below 2**53, else in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), squared distance to it, and both bounds."""
    d = square_distances(x, centroids)
    cluster = d.argmin(axis=1)
    at = np.arange(len(x))
    near = d[at, cluster]
    if len(centroids) == 1:
        return cluster, near, np.sqrt(near) * (1 + SLACK), np.full(len(x), np.inf)
    d[at, cluster] = np.iinfo(np.int64).max
    return cluster, near, np.sqrt(near) * (1 + SLACK), np.sqrt(d.min(axis=1)) * (1 - SLACK)


class Moves:
    """What a round needs to know: the centroids, how far each has come, and half of each one's way to the next one."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray) -> None:
        self.centroids = centroids
        self.drift = np.sqrt(((centroids - before) ** 2).sum(axis=1)) * (1 + SLACK)
        order = np.argsort(-self.drift)
        self.others = np.full(len(centroids), self.drift[order[0]])
        self.others[order[0]] = self.drift[order[1]] if len(order) > 1 else 0.0
        between = square_distances(centroids, centroids)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        self.half = np.sqrt(between.min(axis=1)) / 2 * (1 - SLACK) if len(centroids) > 1 else np.full(1, np.inf)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, bounds, and who was compared with every centroid."""
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.maximum((lower - self.others[cluster]) * (1 - SLACK), 0.0)
        safe = np.maximum(lower, self.half[cluster])
        doubt = np.flatnonzero(upper >= safe)
        upper[doubt] = np.sqrt(((x[doubt] - self.centroids[cluster[doubt]]) ** 2).sum(axis=1)) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= safe[doubt]]
        scanned = np.zeros(len(x), bool)
        scanned[doubt] = True
        if len(doubt):
            cluster = cluster.copy()
            cluster[doubt], _, upper[doubt], lower[doubt] = scan(x[doubt], self.centroids)
        return cluster, upper, lower, scanned


def assigned(rows: DataFrame, moves: Moves | None, centroids: np.ndarray, length: int) -> DataFrame:
    """STATE rows of (id, x), or of STATE rows after their centroids have moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, ROWS):
            x = matrix(b.column(1), length).astype(np.int64)
            if moves is None:
                cluster, near, upper, lower = scan(x, centroids)
                scanned = np.ones(len(x), bool)
            else:
                held = [b.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4)]
                cluster, upper, lower, scanned = moves.assign(x, *held)
                near = ((x - centroids[cluster]) ** 2).sum(axis=1)
            made = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(near), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=[f.split()[0] for f in STATE.split(", ")])

    columns = ["id", "x"] if moves is None else ["id", "x", "cluster", "upper", "lower"]
    return rows.select(*columns).mapInArrow(frugal(run), STATE)


def cluster_sums(state: DataFrame, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each cluster and their componentwise sums. A task adds up its own vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, length), np.int64), np.zeros(k, np.int64)
        for b in gathered(batches, ROWS):
            cluster, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), length).astype(np.int64)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
        found = np.flatnonzero(counts)
        if len(found):
            table = np.column_stack([counts, sums])[found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found, length + 1)), pa.array(np.tile(np.arange(length + 1), len(found))), pa.array(table.reshape(-1))], names=["cluster", "at", "value"])

    parts = state.select("cluster", "x").mapInArrow(frugal(run), "cluster long, at long, value long")
    found = parts.groupBy("cluster", "at").agg(F.sum("value").alias("value")).toArrow()
    table = np.zeros((k, length + 1), np.int64)
    table[found["cluster"].to_numpy(), found["at"].to_numpy()] = found["value"].to_numpy()
    return table[:, 0], table[:, 1:]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", length: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """STATE rows, one for each kept vector, and the final centroids.

    Kept are vectors of exactly ``length`` components, none null or non-finite; a component x counts as floor(scale * x).
    Centroids start as the k kept vectors with the least SHA-256 of ``<seed>:<id>``, in that order (null ids last,
    repeated ids by vector); with fewer vectors there are as many centroids as vectors. Each of ``rounds`` rounds assigns
    all vectors and replaces each centroid that has any by the floor of their mean; then they are assigned once more.
    Ties go to the smaller centroid. Repeated rows count as often as they are there, other columns aren't looked at, an
    empty table gives an empty result. Components beyond 2**27 after scaling are an error: distances wouldn't be exact."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector_col)
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    kept = vectors.where(finite(v) & (F.size(v) == length)).select(F.col(id_col).cast("long").alias("id"), scaled.alias("x"))
    too_large = F.exists("x", lambda c: F.abs(c) > LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit("a scaled component is beyond 2**27"))).otherwise(F.col("x"))
    rows = kept.select("id", checked.cast("array<int>").alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.withColumn("h", order).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), length)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids
    state, path = staged(assigned(rows, None, centroids, length), "clusters")
    for _ in range(rounds):
        counts, sums = cluster_sums(state, len(centroids), length)
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        after, after_path = staged(assigned(state, Moves(moved, centroids), moved, length), "clusters")
        remove(spark, path)
        state, path, centroids = after, after_path, moved
    return state, centroids


def cluster_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **parameters) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept vector, see
    ``clustered``."""
    state, centroids = clustered(vectors, id_col, vector_col, **parameters)
    spark = vectors.sparkSession
    totals = {r.cluster: r.total for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    named = [(i, totals[i], sum(totals.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in totals]
    info = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(info), "cluster")  # k rows
