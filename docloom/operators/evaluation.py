"""How sure an evaluation is: one-pass Poisson bootstrap over judged queries, and thresholds on its lower bounds.

Each resampling counts a query as often as a Poisson number of mean 1 says, which is drawn from a hash of the query's
id: so resamplings need no passes of their own, tasks add up whole numbers, and the same rows give the same intervals in
any order and partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest 32-bit numbers that still draw 0, 1, 2, ... (cumulated Poisson probabilities of mean 1).
BOUNDS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) for n in range(12)]


def times(query: Column, replica: Column, seed: int) -> Column:
    """How often a resampling counts a query: 0 to 12."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), query.cast("string"), replica.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    out = F.lit(0)
    for bound in BOUNDS:
        out = out + (drawn >= bound).cast("int")
    return out


def compared(ours: DataFrame, theirs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """query_id, metric, ours, theirs: a row for each metric of the queries judged in both rankings; a query whose metric
    is null in either (no relevant document) isn't judged."""
    one = ours.select("query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("ours")) for m in metrics))).alias("m")).select("query_id", "m.*")
    two = theirs.select("query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("theirs")) for m in metrics))).alias("m")).select("query_id", "m.*")
    return one.join(two, ["query_id", "metric"]).where("ours is not null and theirs is not null")


def intervals(judged: DataFrame, replicas: int, seed: int = 1, miss_per_mille: int = 25) -> DataFrame:
    """metric, queries, mean, low, high, difference, difference_low, difference_high of ``judged`` (see compared): the mean
    of ours and of ours less theirs over the queries, each with the resamplings' values at ``miss_per_mille`` from either
    end; rounded down to whole units.

    Both rankings are resampled together, so what makes a query hard for both doesn't widen the difference's interval.
    A resampling that counts no query says nothing and is left out; rows of one query count together. Work is queries
    times ``replicas``, added up in the tasks; ``replicas`` rows of sums a metric are shuffled."""
    replica = F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica")
    drawn = judged.select("query_id", "metric", "ours", "theirs", replica).withColumn("w", times(F.col("query_id"), F.col("replica"), seed)).where("w > 0")
    sums = drawn.groupBy("metric", "replica").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("ours")).alias("a"), F.sum(F.col("w") * F.col("theirs")).alias("b"))
    floor = lambda total, n: F.expr(f"cast(floor(({total}) / cast({n} as decimal(19,0))) as bigint)")
    each = sums.select("metric", floor("cast(a as decimal(19,0))", "n").alias("mean"), floor("cast(a - b as decimal(19,0))", "n").alias("difference"))
    at = lambda c, low: F.expr(f"element_at(array_sort(collect_list({c})), cast({'' if low else 'count(1) - '}(count(1) * {miss_per_mille}) div 1000 as int) + {int(low)})")
    spread = each.groupBy("metric").agg(at("mean", True).alias("low"), at("mean", False).alias("high"), at("difference", True).alias("difference_low"), at("difference", False).alias("difference_high"))
    whole = judged.groupBy("metric").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("n"), F.sum("ours").alias("a"), F.sum("theirs").alias("b"))
    plain = whole.select("metric", "queries", floor("cast(a as decimal(19,0))", "n").alias("mean"), floor("cast(a - b as decimal(19,0))", "n").alias("difference"))
    return plain.join(spread, "metric").select("metric", "queries", "mean", "low", "high", "difference", "difference_low", "difference_high")


def thresholds(found: DataFrame, least: Mapping[str, int]) -> DataFrame:
    """``found`` with least, passes (the interval's lower end reaches it; null without a threshold) and verdict on ours
    against theirs: better, worse or undecided (the difference's interval holds 0)."""
    asked = F.lit(None).cast("long")
    for metric, value in least.items():
        asked = F.when(F.col("metric") == metric, F.lit(value).cast("long")).otherwise(asked)
    verdict = F.when(F.col("difference_low") > 0, "better").when(F.col("difference_high") < 0, "worse").otherwise("undecided")
    return found.withColumn("least", asked).withColumn("passes", F.col("low") >= F.col("least")).withColumn("verdict", verdict)


def grounded(points: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """doc_id, point, words, held, grounded of key points (doc_id, point, tokens, block_indexes): how many of a point's
    distinct words its cited blocks (doc_id, block_index, tokens) hold, and whether that is ``least`` millionths of them.

    A point without words or without a block that exists holds none and isn't grounded."""
    words = points.select("doc_id", "point", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("_w"), F.col("block_indexes").alias("_c"))
    cited = words.select("doc_id", "point", "_w", F.explode(F.array_distinct("_c")).alias("block_index"))
    met = cited.join(blocks.select("doc_id", "block_index", F.col("tokens").alias("_t")), ["doc_id", "block_index"])
    held = met.select("doc_id", "point", F.explode(F.array_intersect("_w", "_t")).alias("word")).groupBy("doc_id", "point").agg(F.countDistinct("word").alias("held"))
    out = words.select("doc_id", "point", F.size("_w").cast("long").alias("words")).join(held, ["doc_id", "point"], "left").fillna(0, ["held"])
    return out.withColumn("grounded", (F.col("words") > 0) & (F.col("held") * 1_000_000 >= F.col("words") * least))
