"""Whitening and clustering against plain versions, on rows with nulls, odd lengths, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from docloom.llm import centroid_clusters, queries, whitening
from docloom.llm._shared import ship_package

ROW = "vec_id long, embedding array<float>, x string, id string, vector string, cluster string, value string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", "x") for i, v in rows], ROW).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((300, 7)) * [5, 4, 4, 2, 1, 0.5, 0.1] + 3
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    out += [(5, out[5][1]), (5, out[5][1]), (None, out[9][1]), (400, None), (401, [1.0] * 6 + [None]), (402, [math.nan] + [1.0] * 6), (403, [math.inf] * 7), (404, [1.0, 2.0]), (405, [])]
    return out + [(500 + i, out[0][1]) for i in range(150)]  # a vector that a third of all rows have


def kept(rows, length):
    return [(i, v) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]


def test_whitening_is_the_plain_version_s(spark, rows):
    good = kept(rows, 7)
    x = np.floor(64 * np.array([v for _, v in good], np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = (n * x - sums) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(7)] < 0, -1.0, 1.0)
    plain = z @ u / np.sqrt(e)
    got = whitening.whiten(frame(spark, rows), components=5).collect()
    assert len(got) == 5 * n and {r.component for r in got} == {1, 2, 3, 4, 5}
    key = lambda i, c, d, w: (-1 if i is None else i, c, int(d), round(w, 6) + 0.0)
    wanted = sorted(key(i, c + 1, ((n * v - sums) ** 2).sum(), w[c]) for (i, _), v, w in zip(good, x, plain, strict=True) for c in range(5))
    found = sorted(key(r.vec_id, r.component, r.deviation, r.whitened) for r in got)
    assert [f[:3] for f in found] == [w[:3] for w in wanted]
    assert max(abs(f[3] - w[3]) for f, w in zip(found, wanted, strict=True)) <= 2e-6
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 for r in got)


def test_whitening_of_few_and_equal_vectors(spark):
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    got = whitening.whiten(frame(spark, [(i, [float(i), 2.0, -float(i)]) for i in range(5)])).collect()  # rank 1
    assert {r.component for r in got} == {1} and sorted(round(abs(r.whitened), 9) for r in got) == sorted(round(abs(i - 2) / math.sqrt(2), 9) for i in range(5))


def test_deviations_are_exact_beyond_64_bits(spark):
    rows = [(i, [float(2**30 + i), float(-(2**38) * (i % 3))]) for i in range(40)]
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(wide).collect()}
    assert got == {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(wide.limit(1).selectExpr("vec_id", "array(1e30D, 1D) as embedding"))


def test_block_iterations_converge_where_the_block_is_small(spark):
    rnd = np.random.default_rng(8)
    values = np.concatenate([[9, 8.9999, 8.9998], np.linspace(4, 0.1, 57)])  # a close group, sixty dimensions
    mix = np.linalg.qr(rnd.standard_normal((60, 60)))[0]
    x = rnd.standard_normal((800, 60)) * values @ mix
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ship_package(spark)
    data = whitening.centred(rows, "vec_id", "embedding", 1 << 20)
    e, u, residuals, rounds = whitening.leading_components(data, 3)
    y = np.floor(x * (1 << 20))
    y = y - y.mean(axis=0)
    full, vectors = np.linalg.eigh(y.T @ y / len(y))
    assert np.abs(e / full[::-1][:3] - 1).max() < 1e-12 and residuals.max() <= whitening.CERTIFIED * e[0]
    assert np.abs(np.abs((u * vectors[:, ::-1][:, :3]).sum(axis=0)) - 1).max() < 1e-12 and 2 < rounds < 60


def plain_clusters(rows, length, k, rounds, scale=256):
    v = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in x)) for i, x in kept(rows, length)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(((digest(i), x) for i, x in v))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for r in range(rounds + 1):
        best = [near(x) for _, x in v]
        if r < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x), b in zip(v, best, strict=True) if b[1] == j]
                if mine:
                    centroids[j] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    totals = {j: sum(b[0] for b in best if b[1] == j) for j in range(len(centroids))}
    name = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, b[1], b[0], totals[b[1]], sum(totals.values()), name(b[1])) for (i, _), b in zip(v, best, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (12, 5), (40, 0), (1000, 3)])
def test_clusters_are_the_plain_version_s(spark, rows, k, rounds):
    got = centroid_clusters.cluster_report(frame(spark, rows), length=7, k=k, rounds=rounds).collect()
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == plain_clusters(rows, 7, k, rounds)


def test_bounds_spare_scans_and_empty_tables_stay_empty(spark):
    rnd = random.Random(6)
    spots = [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(8)]
    rows = [(i, [x + rnd.gauss(0, 0.2), y + rnd.gauss(0, 0.2)]) for i in range(600) for x, y in [spots[i % 8]]]
    state, _ = centroid_clusters.clustered(frame(spark, rows), length=2, k=8, rounds=4)
    assert state.where("scanned").count() < 100
    got = centroid_clusters.cluster_report(frame(spark, rows), length=2, k=8, rounds=4).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == [p[:3] for p in plain_clusters(rows, 2, 8, 4)]
    assert centroid_clusters.cluster_report(frame(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="beyond 2"):
        centroid_clusters.cluster_report(frame(spark, [(1, [1e30, 0.0])]), length=2)


def test_distances_of_large_components_are_exact():
    rnd = np.random.default_rng(1)
    x, c = (rnd.integers(-centroid_clusters.LARGEST, centroid_clusters.LARGEST, (5, 64)) for _ in range(2))
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    assert centroid_clusters.square_distances(x, c).tolist() == plain


def test_queries_on_the_small_table(spark, sf_dir):
    got = queries.op11_whitening(spark, sf_dir).collect()
    table = queries.table(spark, sf_dir, "embeddings").collect()
    x = np.floor(64 * np.array([r.embedding for r in table], np.float32).astype(np.float64))
    z = x - x.mean(axis=0)
    e, u = np.linalg.eigh(z.T @ z / len(z))
    plain = {r.vec_id: w for r, w in zip(table, z @ u[:, ::-1][:, :32] / np.sqrt(e[::-1][:32]), strict=True)}
    signs = {}
    for r in got:
        signs.setdefault(r.component, math.copysign(1, r.whitened * plain[r.vec_id][r.component - 1]))
        assert abs(r.whitened - signs[r.component] * plain[r.vec_id][r.component - 1]) < 1e-6
    assert len(got) == 32 * len(table) and got[0].identity_error <= 1e-4
