"""Reconciliation by digests against the plain join of both tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import digest_tree, governance


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_digests_find_what_the_join_finds(spark):
    whole = spark.range(5_000).select(F.col("id").alias("k"), F.when(F.col("id") % 9 != 2, F.col("id").cast("string")).alias("c"), F.lit(1).alias("leaf"), F.lit("x").alias("status"))
    damaged = whole.where("k <> 17").withColumn("c", F.expr("case when k = 4000 then '' when k = 2 then '' when k = 30 then null when k = 40 then '41' when k = 41 then '40' else c end"))
    more = damaged.unionByName(spark.createDataFrame([(9_999, "new", 1, "x"), (None, "a", 1, "x")], "k long, c string, leaf int, status string"))
    got, counts = digest_tree.reconciled_by_digests(whole, more, "k", "c")
    assert rows_of(got) == rows_of(governance.reconciled(whole, more, "k", "c"))
    assert sorted(r.k for r in got.where("status <> 'same' and k is not null").collect()) == [2, 17, 30, 40, 41, 4000, 9_999]
    top, middle, last = counts.orderBy("bits").collect()
    assert top.compared == 16 and 1 <= top.differing <= 7 and middle.compared <= top.differing * 64 and middle.differing <= 7
    assert last.differing == 7 and last.compared <= middle.differing * 64 < 5_000  # few of the rows' ranges are looked at


def test_digests_do_not_mind_order_and_repeat_nothing(spark):
    a = spark.range(2_000).select(F.col("id").alias("k"), F.lit("same").alias("c"))
    assert rows_of(digest_tree.digests(a.repartition(5), "k", "c")) == rows_of(digest_tree.digests(a.orderBy(F.desc("k")), "k", "c"))
    got, counts = digest_tree.reconciled_by_digests(a, a, "k", "c")
    assert got.where("status = 'same'").count() == 2_000 and counts.agg(F.sum("differing"), F.sum("compared")).first()[0:2] == (0, 16)
    for old, new, status in ((a, a.limit(0), "missing"), (a.limit(0), a, "added")):
        found = digest_tree.reconciled_by_digests(old, new, "k", "c")[0].groupBy("status").count().collect()
        assert [tuple(r) for r in found] == [(status, 2_000)]
    assert digest_tree.reconciled_by_digests(a.limit(0), a.limit(0), "k", "c")[0].count() == 0
