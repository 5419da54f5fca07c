"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import remove, staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(node, component) for each linked node, component being its smallest reachable node, and the table's path.

    A step joins every node's larger neighbours, then its smaller ones, to the smallest one around it; edges only
    turn towards smaller nodes, until each node has one edge, to the smallest of its component. All of it is grouping
    and joining on narrow rows; a node of very many neighbours is only ever reduced to a minimum. Each round's edges
    are written to the shared folder. Rounds grow with the logarithm of the links and go on until only stars are left."""
    spark = links.sparkSession
    edges, path = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    rows = 2 * edges.count()
    while not is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        after, after_path = staged(small.distinct(), "edges", rows)
        remove(spark, path)
        edges, path = after, after_path
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out, out_path = staged(nodes.unionByName(roots), "components", rows)
    remove(spark, path)
    return out, out_path


def is_star_forest(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
