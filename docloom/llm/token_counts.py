"""Token counts through an exact histogram of encoded lengths.

Documents are encoded once and only (group, length) leaves a task; counts are combined before the shuffle. From then on
every answer comes from the histogram: with suffix sums, a context limit's totals need its own row alone. Sums run on
two levels, over ranges of lengths and inside each range, so no task sorts the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._bytes import row_blocks, text_buffers
from docloom.llm._shared import frugal, ship_package, small_batches, staged

#: Lengths whose running sums one task makes.
RANGE = 1024


def encoded_lengths(docs: DataFrame, tokenizer_path: str, keep: Sequence[str] = (), text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of ids of each row's whole text (null: 0)."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm._tokens import unit_tokenizer

        tokenizer = unit_tokenizer(tokenizer_path)
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            n = [tokenizer.lengths(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_blocks(offsets)]
            n = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n)], names=[*b.schema.names[1:], name])

    fields = [docs.schema[c] for c in keep]
    return docs.select(F.col(text_col), *keep).mapInArrow(frugal(run, "tokenizer"), T.StructType([*fields, T.StructField(name, T.LongType())]))


def length_histogram(docs: DataFrame, tokenizer_path: str, groups: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """The group columns, n_tokens and n_documents. Null text has length 0; null is a group of its own; an empty table has no rows."""
    return encoded_lengths(docs, tokenizer_path, groups, text_col).groupBy(*groups, "n_tokens").agg(F.count(F.lit(1)).alias("n_documents"))


def limit_report(histogram: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """A row for each length that occurs, as a context limit, by suffix sums:

    documents_from, tokens_from: documents of at least this length and their tokens; total_documents, total_tokens: of
    the group; truncated_tokens: what stays when each document is cut to this length; quantile: the share of documents
    of at most this length."""
    keys = [*groups, "piece"]
    cut = histogram.withColumn("piece", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_documents"))
    by = ", ".join(f"`{g}`" for g in groups)
    part = f"partition by {by}" if groups else ""
    pieces = cut.groupBy(*keys).agg(F.sum("n_documents").alias("d"), F.sum("tokens").alias("t"))
    after = f"over ({part} order by piece desc rows between unbounded preceding and 1 preceding)"
    pieces = pieces.selectExpr(*(f"`{g}` as `_{g}`" for g in groups), "piece as _piece", f"coalesce(sum(d) {after}, 0) as later_d", f"coalesce(sum(t) {after}, 0) as later_t", f"sum(d) over ({part}) as total_documents", f"sum(t) over ({part}) as total_tokens")
    same = F.col("piece") == F.col("_piece")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    inner = f"over (partition by {', '.join(f'`{k}`' for k in keys)} order by n_tokens desc)"
    sums = cut.join(pieces, same).withColumn("documents_from", F.expr(f"sum(n_documents) {inner}") + F.col("later_d")).withColumn("tokens_from", F.expr(f"sum(tokens) {inner}") + F.col("later_t"))
    truncated = F.col("total_tokens") - F.col("tokens_from") + F.col("documents_from") * F.col("n_tokens")
    quantile = (F.col("total_documents") - F.col("documents_from") + F.col("n_documents")) / F.col("total_documents")
    return sums.select(*groups, "n_tokens", "n_documents", "documents_from", "tokens_from", "total_documents", "total_tokens", truncated.alias("truncated_tokens"), quantile.alias("quantile"))


def quantile_lengths(report: DataFrame, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """For each share: the smallest length that this share of documents doesn't exceed."""
    asked = report.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).where("quantile >= share")
    return asked.groupBy(*groups, "share").agg(F.min("n_tokens").alias("n_tokens"))


def totals_at(histogram: DataFrame, limits: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """For each context limit, whether it occurs as a length or not: tokens after truncation, and documents cut."""
    rows = histogram.withColumn("context", F.explode(F.array(*(F.lit(int(x)) for x in limits))))
    return rows.groupBy(*groups, "context").agg(F.sum(F.least("n_tokens", "context") * F.col("n_documents")).alias("truncated_tokens"), F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_documents")).otherwise(0)).alias("documents_cut"))


def token_report(docs: DataFrame, tokenizer_path: str, groups: Sequence[str] = ()) -> DataFrame:
    histogram, _ = staged(length_histogram(docs, tokenizer_path, groups), "length-histogram")
    return limit_report(histogram, groups)
