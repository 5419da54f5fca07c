"""Calls at once and quantiles of latencies against plain versions of themselves."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.operators import latency

CALLS = "scope string, start_ms long, end_ms long, extra int"


def swept(rows):
    """By scope: calls that run at each instant at which any begins or ends."""
    out = defaultdict(list)
    for scope in {r[0] for r in rows}:
        real = [(a, b) for s, a, b, _ in rows if s == scope and a is not None and b is not None and b > a]
        for at in sorted({t for call in real for t in call}):
            out[scope].append((at, sum(a <= at < b for a, b in real)))
    return out


def test_calls_at_once(spark):
    rnd = random.Random(4)
    hot = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]), rnd.randrange(500), 0, 1) for _ in range(300)]
    rows = [(s, a, a + rnd.randrange(0, 40), x) for s, a, _, x in hot] + [("a", 5, None, 1), ("a", None, 9, 1), ("a", 9, 5, 1), ("none", 3, 3, 1)]
    rows += [("touch", 0, 10, 1), ("touch", 10, 20, 1), ("touch", 10, 20, 1), ("touch", 30, 40, 1), ("touch", 30, 40, 1)]  # one ends as others begin
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    plain = swept(rows)
    for stretch in (7, 100_000):  # in many stretches and in one
        got = {r.scope: (r.peak, r.peak_at_ms) for r in latency.peaks(calls, "scope", stretch).collect()}
        assert got == {s: max(((n, t) for t, n in at), key=lambda x: (x[0], -x[1])) for s, at in plain.items()}
        for most in (0, 1, 3):
            expected = set()
            for scope, at in plain.items():
                begun = None
                for t, n in at:
                    if n > most:
                        begun = (begun[0], max(begun[1], n)) if begun else (t, n)
                    elif begun:
                        expected.add((scope, begun[0], t, begun[1]))
                        begun = None
            found = latency.periods_over(calls, "scope", most, stretch)
            assert {(r.scope, r.from_ms, r.until_ms, r.peak) for r in found.collect()} == expected
    assert latency.peaks(calls.limit(0), "scope").count() == 0 and latency.periods_over(calls.limit(0), "scope", 1).count() == 0


def test_sketches_roll_up_within_their_bound(spark):
    n, shares = 60_000, (0.0, 0.25, 0.5, 0.99, 1.0)
    value = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)))  # a third of all alike
    calls = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 != 1, "b").alias("scope"), F.timestamp_seconds(F.col("id") * 11 % 900_000).alias("ts"), F.when(F.col("id") % 101 != 3, value).alias("ms"))
    hours = latency.sketches(calls, "scope", "ts", "ms").cache()
    known = calls.where("ms is not null")
    assert hours.agg(F.sum("n")).first()[0] == known.count()
    found = latency.quantiles(latency.merged_sketches(hours, "scope"), shares).cache()
    exact = {r.scope: r for r in known.groupBy("scope").agg(F.count("*").alias("n"), F.min("ms").alias("least"), F.max("ms").alias("greatest")).collect()}
    for r in found.collect():
        e = exact[r.scope]
        assert (r.n, r.least, r.greatest) == (e.n, e.least, e.greatest)
        assert r.quantile not in (0.0, 1.0) or r.latency == (e.least if r.quantile == 0.0 else e.greatest)
    values = {s: sorted(r.ms for r in known.where(F.col("scope").eqNullSafe(F.lit(s))).collect()) for s in exact}
    for r in latency.rank_errors(calls, "scope", "ms", found, shares).collect():
        held = values[r.scope]
        got = next(x.latency for x in found.collect() if (x.scope, x.quantile) == (r.scope, r.quantile))
        under, upto = sum(v < got for v in held) / len(held), sum(v <= got for v in held) / len(held)
        assert r.n == len(held) and abs(r.error - max(0, r.quantile - upto, under - r.quantile)) < 1e-9
        assert r.error <= latency.RANK_ERROR
    whole = latency.quantiles(latency.merged_sketches(hours), (0.5,)).collect()
    assert len(whole) == 1 and whole[0].n == known.count()
    assert latency.quantiles(latency.sketches(calls.limit(0), "scope", "ts", "ms"), shares).count() == 0
    assert latency.sketches(calls.where("ms is null"), "scope", "ts", "ms").count() == 0
