"""Uniform shuffle of documents into shards of exact sizes through a hypergeometric communication matrix.

Input partition p has n(p) rows and shard s takes m(s) rows, known beforehand. How many rows go from p to s is drawn
from the multivariate hypergeometric law, partition by partition, given what the shards still lack: the matrix of a
uniform permutation. A partition then deals its rows to shards in random order (local permutation), rows move once,
and each shard orders its rows at random again. For that, a row has a random 64-bit key; the key's high part names a
cell of its shard, so no task holds a shard, and a row's slot is the number of rows in its shard's earlier cells plus
its place in its own.

A partition is a stretch of BLOCK rows of one input file, by Spark's row index, however the file is split into tasks.
Shard and key follow from the stretch, the place in it and the seed alone, so the cells are counted without reading a
row, and a task that is run again, elsewhere or with other splits, deals as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._bytes import mix
from docloom.llm._shared import free_name, ship_package, small_batches, staged

#: Rows of an input file that make a partition.
BLOCK = 1 << 18
#: Population from which on numpy's sampler refuses, and standard deviations around the mode that ours looks at.
LARGE, REACH = 10**9, 12


def even_sizes(rows: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.full(parts, rows // parts) + (np.arange(parts) < rows % parts)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad ones are good, at any size.

    Large populations: probabilities relative to the mode's follow from exact ratios of neighbours, and their running
    sum is inverted. What lies over REACH standard deviations away has less mass than a double can tell from none."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    reach = int(REACH * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 50
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))  # of each k to the next
    logs = np.concatenate([[0], np.cumsum(steps)])
    running = np.cumsum(np.exp(logs - logs[mode - lo]))
    return lo + int(np.searchsorted(running, rng.random() * running[-1], side="right"))


def multivariate(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn from cells of these sizes come from each: a hypergeometric draw for each cell against the rest."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, size in enumerate(left.tolist()):
        rest -= size
        out[s] = hypergeometric(rng, size, rest, n) if n else 0
        n -= int(out[s])
    return out


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row p: how many rows of partition p each cell takes. Rows sum to counts, columns to sizes."""
    rng, left = np.random.default_rng(seed), sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts.tolist()):
        out[p] = multivariate(rng, left, n)
        left -= out[p]
    return out


def plan_of(partition: int, counts: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, cell and key of each row of a partition."""
    rng = np.random.default_rng([seed, partition])
    shard = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rng.shuffle(shard)
    key = mix(rng.integers(0, 1 << 63, len(shard), dtype=np.uint64)) >> np.uint64(1)
    cell = ((key >> np.uint64(31)) * np.uint64(cells) >> np.uint64(32)).astype(np.int32)
    return shard, cell, key.astype(np.int64)


def deal(matrix, cells: int, seed: int, names: list[str]):
    """Adds to each row, whose last two columns name its file and its place there, its shard, cell and key instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plan = None, None
        for b in batches:
            file, index = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
            block = index // BLOCK
            out = [np.zeros(b.num_rows, t) for t in (np.int32, np.int32, np.int64)]
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1, [b.num_rows]])
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if i == j:
                    continue
                if (name := (int(file[i]), int(block[i]))) != at:
                    at, plan = name, plan_of(*matrix.value[name], cells, seed)
                for o, x in zip(out, plan, strict=True):
                    o[i:j] = x[index[i:j] % BLOCK]
            columns = b.columns[: b.num_columns - 2]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(o) for o in out)], names=[*b.schema.names[: len(columns)], *names])

    return run


def cell_counts(matrix, cells: int, seed: int):
    """(shard, cell, rows) of each partition named in the input by file and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, cell, _ = plan_of(*matrix.value[name], cells, seed)
                at, n = np.unique(shard.astype(np.int64) * cells + cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((at // cells).astype(np.int32)), pa.array((at % cells).astype(np.int32)), pa.array(n.astype(np.int64))], names=["shard", "cell", "rows"])

    return run


def stretches(docs: DataFrame) -> tuple[F.Column, list[tuple[int, int, int]]]:
    """A hash of the input file's path that no two files share, and (hash, block, rows) of each stretch in order."""
    salt = 0
    while True:
        file = F.xxhash64(F.col("_metadata.file_path"), F.lit(salt))
        named = docs.select(file.alias("f"), F.floor(F.col("_metadata.row_index") / BLOCK).alias("b"), F.col("_metadata.file_path").alias("p"))
        found = named.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"), F.max("p").alias("q")).collect()  # one row for each stretch
        paths: dict[int, set] = {}
        for r in found:
            paths.setdefault(r["f"], set()).update((r["p"], r["q"]))
        if all(len(p) == 1 for p in paths.values()):
            return file, [(r["f"], r["b"], r["n"]) for r in sorted(found, key=lambda r: (r["p"], r["b"]))]
        salt += 1


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 7, cell_rows: int = 10_000, stable_input: bool = False) -> DataFrame:
    """``docs`` with shard (0 to shards-1) and slot (gapless from 0 in each shard), a uniform random order.

    Shard sizes are at most one row apart. Every row counts for itself: repeated rows, null columns, empty and very long
    texts are dealt like any other; an empty table gives an empty result; columns of ``docs`` named shard or slot are
    replaced. ``stable_input`` says that ``docs`` holds all rows of Parquet files that don't change; anything else is
    written to the shared folder first."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    docs = docs.drop("shard", "slot")
    if not stable_input:
        docs, _ = staged(docs, "to-shard")
    file_name, place, cell, order = free_name(docs, "file", "place", "cell", "order")
    file, found = stretches(docs)
    rows = sum(n for _, _, n in found)
    cells = max(1, -(-rows // (shards * cell_rows)))
    drawn = communication_matrix(np.array([n for _, _, n in found], np.int64), even_sizes(rows, shards), seed)
    matrix = spark.sparkContext.broadcast({(f, b): (p, drawn[p]) for p, (f, b, _) in enumerate(found)})  # shards numbers for each stretch
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(cell, T.IntegerType()), T.StructField(order, T.LongType())])
    with_place = docs.select(*docs.columns, file.alias(file_name), F.col("_metadata.row_index").alias(place))
    dealt = with_place.mapInArrow(deal(matrix, cells, seed, ["shard", cell, order]), schema)
    parts = spark.createDataFrame([(f, b) for f, b, _ in found], "f long, b long")
    sizes = parts.mapInArrow(cell_counts(matrix, cells, seed), "shard int, cell int, rows long").groupBy("shard", "cell").agg(F.sum("rows").alias("rows"))
    starts = sizes.selectExpr("shard", f"cell as `{cell}`", "sum(rows) over (partition by shard order by cell) - rows as slot")
    ranked = dealt.withColumn(place, F.expr(f"row_number() over (partition by shard, `{cell}` order by `{order}`) - 1").cast("long"))
    return ranked.join(starts, ["shard", cell]).select(*docs.columns, "shard", (F.col("slot") + F.col(place)).alias("slot"))
