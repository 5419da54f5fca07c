"""MinHash near-dedup against comparing all pairs, and its sequential test against the posterior it stands for."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import DOCS, texts, words_of

from docloom.llm import minhash_dedup as M
from docloom.llm.jaccard_join import Rule


def plain(rows, words=3, share=85):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted(((rows[i][0], len(sets[i]), min((d for d in least[root(i)] if d is not None), default=None)) for i in range(len(rows))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_minhash_dedup(spark):
    docs = spark.createDataFrame([(i, t, *["x"] * 2, 0, *["x"] * 7) for i, t in texts()], DOCS).repartition(3)
    assert found(M.near_duplicates(docs)) == plain(texts())
    empty = spark.createDataFrame([], DOCS)
    assert M.near_duplicates(empty).count() == 0 and M.one_of_each(empty).count() == 0
    left = M.one_of_each(docs)
    assert left.columns == docs.columns
    assert len({r.doc_id for r in left.collect() if words_of(r.text)}) == len(Counter(c for _, n, c in set(plain(texts())) if n))


@pytest.mark.parametrize("tile", [3, 9, 4096])
def test_long_lists_are_compared_in_stretches(spark, tile):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            w[rnd.randrange(90)] = f"e{rnd.randrange(5) if i % 2 else i}"
        rows.append((i, " ".join(w[: rnd.choice([90, 88, 60])])))
    got = found(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile))
    assert got == plain(rows) and len({c for _, _, c in got}) > 3


def test_short_and_very_long_texts(spark):
    long = " ".join(f"w{i % 70001}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c"), (8, "a b c d"), (9, "b a"), (10, " a\tb ")]
    assert found(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_agreements_follow_the_posterior():
    for n in (24, 96, 240):
        grid = (np.arange(200_000) + 0.5) / 200_000
        for miss in (1e-3, 1e-9):
            m = M.least_agreements(n, 85, 100, miss)
            for k, enough in ((m, True), (m - 1, False)):
                log = k * np.log(grid) + (n - k) * np.log1p(-grid)
                density = np.exp(log - log.max())
                assert (density[grid >= 0.85].sum() / density.sum() >= miss) == enough


def test_sequential_test_keeps_similar_pairs_and_drops_others():
    rnd, rule = np.random.default_rng(2), Rule(85, 100)
    a = rnd.integers(0, 1 << 16, (4000, M.HASHES), dtype=np.uint16)
    for similarity, least, most in ((0.85, 4000, 4000), (0.5, 0, 0), (0.65, 0, 400)):
        b = np.where(rnd.random(a.shape) < similarity, a, a + np.uint16(1))
        assert least <= len(M.surviving(a, b, rule, M.MISS)) <= most


def test_minima_agree_as_often_as_sets_are_similar():
    rnd = np.random.default_rng(7)
    for size, common in ((8, 7), (300, 270), (5000, 2500)):
        agree = []
        for _ in range(60):
            x = rnd.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64) * np.uint64(2)
            agree.append((M.signature(np.sort(x[:size])) == M.signature(np.sort(x[size - common :]))).mean())
        wanted = common / (2 * size - common)
        assert abs(np.mean(agree) - wanted) < 5 * math.sqrt(wanted * (1 - wanted) / (60 * M.HASHES)) + 0.002


def test_parities_bound_the_difference_of_sets():
    rnd, rule = np.random.default_rng(11), Rule(85, 100)
    refused = 0
    for n in (1, 5, 90, 1000, 1030, 30_000):
        for share in (0.0, 0.05, 0.1, 0.2, 0.3):
            x = np.unique(rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[round(share * n) : n], x[n : n + round(share * n) // 2]]))
            row = lambda s: np.frombuffer(M.parity(s), np.uint8)[None]
            similar = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
            may = bool(M.may_link(rule, len(a), len(b), row(a), row(b))[0])
            assert may or not similar
            refused += not may
    assert refused >= 8
