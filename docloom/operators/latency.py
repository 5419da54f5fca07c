"""Calls in time: how many run at once, and how long they take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.governance import running_totals
from docloom.sources.stage import staged


def overlaps(calls: DataFrame, scope: str, stretch_ms: int = 3_600_000) -> DataFrame:
    """scope, at_ms, delta, running: how many calls (start_ms, end_ms) of a scope run from each instant at which that
    changes, by a sweep over starts and ends. A call runs from its start up to but not at its end; one without a start or
    an end, or that ends no later than it starts, runs never. A null scope is one of its own.

    Starts and ends of an instant are netted in map tasks first, and the sweep is on two levels, in stretches of time and
    over them, so a scope with a third of all calls is many tasks' work."""
    real = calls.where("end_ms > start_ms").select(scope, "start_ms", "end_ms")
    points = real.select(scope, F.explode(F.array(F.struct(F.col("start_ms").alias("at_ms"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("end_ms").alias("at_ms"), F.lit(-1).cast("long").alias("delta")))).alias("p"))
    net = points.groupBy(scope, F.col("p.at_ms").cast("long").alias("at_ms")).agg(F.sum("p.delta").alias("delta")).where("delta <> 0")
    return running_totals(staged(net, "overlaps"), [scope], "at_ms", "delta", stretch_ms)


def peaks(calls: DataFrame, scope: str, stretch_ms: int = 3_600_000) -> DataFrame:
    """scope, peak (most calls at once), peak_at_ms (when that was first)."""
    best = F.max(F.struct("running", (-F.col("at_ms")).alias("_before")))
    return overlaps(calls, scope, stretch_ms).groupBy(scope).agg(best.alias("_b")).select(scope, F.col("_b.running").alias("peak"), (-F.col("_b._before")).alias("peak_at_ms"))


def periods_over(calls: DataFrame, scope: str, most: int, stretch_ms: int = 3_600_000) -> DataFrame:
    """scope, from_ms, until_ms, peak: the longest periods in which more than ``most`` calls of a scope run at once. The
    periods are numbered by a second running total, of the instants at which one begins."""
    now, before = F.col("running") > most, F.col("running") - F.col("delta") > most
    swept = overlaps(calls, scope, stretch_ms).where(now | before).withColumn("begins", (now & ~before).cast("long"))
    numbered = running_totals(staged(swept.withColumnRenamed("running", "at_once"), "periods"), [scope], "at_ms", "begins", stretch_ms)
    return numbered.groupBy(scope, F.col("running").alias("_period")).agg(F.min("at_ms").alias("from_ms"), F.max("at_ms").alias("until_ms"), F.max("at_once").alias("peak")).drop("_period")


#: Size of a sketch, and the share of rows by which a quantile's rank may be wrong: single quantiles are within 0.007 with
#: 99 % of all sketches of this size, however many were merged, so that 0.02 is far outside what occurs.
SKETCH, RANK_ERROR = 400, 0.02


def sketches(calls: DataFrame, scope: str, at: str, latency: str, window: str = "1 hour") -> DataFrame:
    """scope, window_start, n, least, greatest, sketch (KLL, a few kB) of the latencies (whole numbers) of each window: what
    is kept of them. Calls without a time or a latency count nowhere; a null scope is one of its own. Sketches are merged
    in map tasks before the shuffle."""
    rows = calls.where(F.col(at).isNotNull() & F.col(latency).isNotNull()).select(scope, F.window(F.col(at).cast("timestamp"), window)["start"].alias("window_start"), F.col(latency).cast("long").alias("_v"))
    return rows.groupBy(scope, "window_start").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.kll_sketch_agg_bigint("_v", SKETCH).alias("sketch"))


def merged_sketches(kept: DataFrame, *by: str | Column) -> DataFrame:
    """Sketches rolled up to ``by``, coarser windows or several scopes, without the rows that they were made of."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_bigint("sketch", SKETCH).alias("sketch"))


def quantiles(kept: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``kept`` without the sketch, a row for each share: quantile, latency (that of a row whose rank is within RANK_ERROR
    of it)."""
    each = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("latency")) for q in shares)))
    return kept.withColumn("_q", each).select(*(c for c in kept.columns if c != "sketch"), "_q.quantile", "_q.latency")


def rank_errors(calls: DataFrame, scope: str, latency: str, found: DataFrame, shares: Sequence[float]) -> DataFrame:
    """scope, quantile, n, error: by what share of the scope's calls the rank of each found latency is wrong, against all
    of them. A latency that many calls share has all of their ranks."""
    one = found.groupBy(F.col(scope).alias("_scope")).agg(*(F.max(F.when(F.col("quantile") == q, F.col("latency"))).alias(f"_{i}") for i, q in enumerate(shares)))
    both = calls.where(F.col(latency).isNotNull()).select(scope, F.col(latency).alias("_v")).join(one, F.col(scope).eqNullSafe(F.col("_scope")))
    counted = lambda c: F.sum(c.cast("long"))
    sums = both.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.struct(F.lit(float(q)).alias("quantile"), counted(F.col("_v") < F.col(f"_{i}")).alias("under"), counted(F.col("_v") <= F.col(f"_{i}")).alias("upto")) for i, q in enumerate(shares))).alias("each"))
    wrong = F.greatest(F.lit(0.0), F.col("e.quantile") - F.col("e.upto") / F.col("n"), F.col("e.under") / F.col("n") - F.col("e.quantile"))
    return sums.select(scope, "n", F.explode("each").alias("e")).select(scope, "e.quantile", "n", wrong.alias("error"))
