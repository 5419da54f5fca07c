"""Intervals of resampled evaluations against plain resampling, thresholds and grounding."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

from docloom.operators import evaluation

JUDGED = "query_id long, metric string, ours long, theirs long"


def plain_times(query, replica, seed):
    u, total, n = int(hashlib.md5(f"{seed}:{query}:{replica}".encode()).hexdigest()[:8], 16) / 2**32, 0.0, 0
    while n < 12 and u >= (total := total + math.exp(-1) / math.factorial(n)):
        n += 1
    return n


def plain_intervals(rows, replicas, seed, miss):
    out = {}
    for metric in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == metric]
        means, differences = [], []
        for replica in range(replicas):
            w = [plain_times(r[0], replica, seed) for r in mine]
            if n := sum(w):
                a, b = (sum(x * r[c] for x, r in zip(w, mine, strict=True)) for c in (2, 3))
                means.append(a // n), differences.append((a - b) // n)
        means.sort(), differences.sort()
        n, k = len(mine), len(means) * miss // 1000
        a, b = sum(r[2] for r in mine), sum(r[3] for r in mine)
        out[metric] = (len({r[0] for r in mine}), a // n, means[k], means[-1 - k], (a - b) // n, differences[k], differences[-1 - k])
    return out


def test_intervals_equal_plain_resampling(spark):
    rnd = random.Random(3)
    rows = [(q, m, rnd.randrange(1_000_001), rnd.randrange(900_000)) for q in range(60) for m in ("precision", "recall") if rnd.random() < 0.8] + [(7, "precision", 5, 5), (7, "precision", 5, 5), (1, "single", 10, 11)]
    for seed, miss in ((1, 25), (9, 100)):
        for parts in (1, 5):
            found = evaluation.intervals(spark.createDataFrame(rows, JUDGED).repartition(parts), 200, seed, miss).collect()
            assert {r.metric: tuple(r)[1:] for r in found} == plain_intervals(rows, 200, seed, miss)
    assert evaluation.intervals(spark.createDataFrame([], JUDGED), 10).count() == 0


def test_an_interval_holds_the_true_mean_about_as_often_as_it_says(spark):
    rnd, hit = random.Random(11), 0
    rows = [(q, str(i), int(rnd.random() < 0.3) * 1000, 0) for i in range(100) for q in range(1000 * i, 1000 * i + 150)]
    found = evaluation.intervals(spark.createDataFrame(rows, JUDGED), 300).collect()
    hit = sum(r.low <= 300 <= r.high for r in found)
    assert len(found) == 100 and hit >= 86  # 95 expected; fewer than 87 has a probability of about 1e-4


def test_thresholds_and_verdicts(spark):
    rows = [(q, "recall", 900 + q % 2, 100) for q in range(30)] + [(q, "precision", 100, 100 + 10 * (q % 2 * 2 - 1)) for q in range(30)] + [(q, "other", 1, 9) for q in range(30)]
    got = {r.metric: (r.least, r.passes, r.verdict) for r in evaluation.thresholds(evaluation.intervals(spark.createDataFrame(rows, JUDGED), 100), {"recall": 900, "precision": 101}).collect()}
    assert got == {"recall": (900, True, "better"), "precision": (101, False, "undecided"), "other": (None, None, "worse")}
    one = spark.createDataFrame([(1, 5, None), (2, 6, 1), (3, 7, 2)], "query_id long, precision long, recall long")
    two = spark.createDataFrame([(1, 4, 1), (2, 3, 1), (9, 1, 1)], "query_id long, precision long, recall long")
    assert sorted(map(tuple, evaluation.compared(one, two, ["precision", "recall"]).collect())) == [(1, "precision", 5, 4), (2, "precision", 6, 3), (2, "recall", 1, 1)]


def test_grounded(spark):
    points = spark.createDataFrame([(1, 0, ["a", "b", "a"], [0, 1, 1]), (1, 1, ["a", "x", "y"], [0]), (1, 2, [], [0]), (1, 3, None, None), (1, 4, ["a"], [9]), (2, 0, ["a"], [0])], "doc_id long, point int, tokens array<string>, block_indexes array<long>")
    blocks = spark.createDataFrame([(1, 0, ["a", "a", "c"]), (1, 1, ["b"]), (2, 0, None)], "doc_id long, block_index long, tokens array<string>")
    got = {(r.doc_id, r.point): (r.words, r.held, r.grounded) for r in evaluation.grounded(points, blocks, 500_000).collect()}
    expected = defaultdict(lambda: (0, 0, False)) | {(1, 0): (2, 2, True), (1, 1): (3, 1, False), (1, 4): (1, 0, False), (2, 0): (1, 0, False), (1, 2): (0, 0, False), (1, 3): (0, 0, False)}
    assert got == dict(expected)
