"""Two tables held against each other by digests of key ranges: only rows of ranges that differ are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.governance import reconciled
from docloom.sources.stage import staged

#: Bits of the key's hash that number the ranges of each level; the last level's are the leaves, 65,536 of them.
LEVELS = (4, 10, 16)


def _leaf(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def digests(rows: DataFrame, key: str, content: str, bits: int = LEVELS[-1]) -> DataFrame:
    """leaf, n, a, b of each range of keys (by their hash, so ranges are alike however keys are spread): its rows and two
    exact sums of unlike hashes of key and content, which no order of rows changes. A row for a range: what is kept of a
    table to hold others against it. Rows without a key are in none."""
    told = (F.col(key), F.col(content), F.col(content).isNull())
    known = rows.where(F.col(key).isNotNull()).select(_leaf(key, bits).alias("leaf"), F.xxhash64(*told).cast("decimal(20,0)").alias("a"), F.hash(*told).cast("long").alias("b"))
    return known.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def descended(old: DataFrame, new: DataFrame, levels: Sequence[int] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of two tables' digests: the leaves that differ, and bits, compared and differing: how many ranges each level has
    compared, which are those below a range that differs on the level above, and found to differ."""
    both = staged(old.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(-1))), "digests")
    differ, counts = None, None
    for i, bits in enumerate(levels):
        at = F.shiftrightunsigned("leaf", levels[-1] - bits)
        rows = both if differ is None else both.join(differ.withColumnRenamed("leaf", "_above"), F.shiftrightunsigned("leaf", levels[-1] - levels[i - 1]) == F.col("_above"), "left_semi")
        ranges = staged(rows.groupBy(at.alias("leaf")).agg(*(F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n", "a", "b"))), "ranges")
        differ = ranges.where("n <> 0 or a <> 0 or b <> 0").select("leaf")
        level = ranges.agg(F.lit(bits).alias("bits"), F.count(F.lit(1)).alias("compared"), F.sum(F.when(F.expr("n <> 0 or a <> 0 or b <> 0"), 1).otherwise(0)).cast("long").alias("differing"))
        counts = level if counts is None else counts.unionByName(level)
    return differ, counts


def reconciled_by_digests(old: DataFrame, new: DataFrame, key: str, content: str, levels: Sequence[int] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """What ``reconciled`` gives, key and status of each row of either side, of tables whose keys don't repeat, and the
    levels' counts. Rows of a range whose digests agree are the same unread; only the others, and rows without a key, are
    shuffled and compared."""
    differ, counts = descended(digests(old, key, content, levels[-1]), digests(new, key, content, levels[-1]), levels)
    marked = differ.select(F.col("leaf").alias("_leaf"), F.lit(True).alias("_differs"))

    def split(rows: DataFrame) -> DataFrame:
        return rows.select(key, content).join(marked, _leaf(key, levels[-1]) == F.col("_leaf"), "left").withColumn("_compare", F.col("_differs").isNotNull() | F.col(key).isNull())

    a, b = split(old), split(new)
    same = b.where("not _compare").select(key, F.lit("same").alias("status"))
    return same.unionByName(reconciled(a.where("_compare"), b.where("_compare"), key, content)), counts
