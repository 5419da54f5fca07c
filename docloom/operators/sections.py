"""Chunks of documents, cut inside the row: no text is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(items: Column, first: Column) -> Column:
    """``items`` cut in stretches that begin at the places ``first`` (from 0, rising): structs of first and items."""
    until = lambda i: F.coalesce(F.get(first, i + 1), F.size(items))
    return F.transform(first, lambda at, i: F.struct(at.alias("first"), F.slice(items, at + 1, until(i) - at).alias("items")))


def section_chunks(documents: DataFrame, chars: int, key: str = "page_id") -> DataFrame:
    """``key``, chunk, path, title_hash, first_block, last_block, n_chars, content_hash: the blocks of one section, in order,
    by the stretch of ``chars`` characters of it in which they begin; documents are rows of ``key`` and blocks with path
    and begin (see page_ir).

    A block is never cut, so a longer one is a chunk of more than ``chars``. ``path`` names the section's headings by
    their places, title_hash is of the innermost one's text (null before the first). A section that another region
    interrupts goes on in a new chunk; a document without blocks has none."""
    rows = documents.select(key, F.col("blocks").alias("_b"), F.transform("blocks", lambda b: F.struct(b["path"].alias("p"), b["region"].alias("r"), F.floor(b["begin"] / chars).alias("s"))).alias("_k"))
    places = F.when(F.size("_k") > 0, F.sequence(F.lit(0), F.size("_k") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 0) | ~F.get(F.col("_k"), i).eqNullSafe(F.get(F.col("_k"), i - 1)))
    cut = rows.withColumn("_f", first).select(key, "_b", F.posexplode(runs(F.col("_b"), F.col("_f"))).alias("chunk", "c"))
    path, n = F.get(F.col("c.items"), F.lit(0))["path"], F.size("c.items")
    texts = F.transform("c.items", lambda b: b["text"])
    title = F.when(F.size(path) > 0, F.sha2(F.get(F.col("_b"), F.element_at(path, -1))["text"], 256))
    chars_in = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.char_length(t))
    return cut.select(key, F.col("chunk").cast("long").alias("chunk"), path.alias("path"), title.alias("title_hash"), F.col("c.first").cast("long").alias("first_block"), (F.col("c.first") + n - 1).cast("long").alias("last_block"), chars_in.alias("n_chars"), F.sha2(F.array_join(texts, "\n"), 256).alias("content_hash"))
