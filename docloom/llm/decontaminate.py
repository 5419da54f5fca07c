"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Text is words of letters, digits and marks of any script, without regard to case or to how accents are encoded; all
other signs part words. Every n-gram of an item is a seed, at every place it has there, however common it is: which ones
an edited copy keeps isn't known, and those that no document has cost nothing. A document that has a seed is compared
with the item around it: if as many of the item's words occur there as the least score takes, local alignment of the two
word sequences gives a score, the share of the item that is matched less what edits cost.

The items are the query set. They go to every task in blocks of bounded size, and a block's pass reads all documents;
no document leaves its task for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _bytes as B
from docloom.llm._shared import free_name, keep_only, ship_package, small_batches

MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5


@dataclass(frozen=True)
class Settings:
    words: int = 3  #: of a seed
    min_score: float = 0.5
    block_bytes: int = 8 << 20  #: of items' texts that tasks get at once


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: word hashes, their starts and ends in the block, first words of rows, first bytes of rows."""
    data, offsets = B.text_buffers(texts)
    for i, j in B.row_blocks(offsets):
        local = offsets[i : j + 1] - offsets[i]
        yield (*B.letter_words(data[offsets[i] : offsets[j]], local), local)


class Items:
    """A block of test items: word sequences, and seeds with the items they come from and their first and last place there."""

    def __init__(self, texts: list[str | None], words: int) -> None:
        self.sequences: list[np.ndarray] = []
        found: list[np.ndarray] = []
        for hashes, _, _, first, _ in words_of(pa.array(texts, pa.string())):
            grams, begin = B.gram_hashes(hashes, first, words)
            self.sequences += [hashes[first[k] : first[k + 1]] for k in range(len(first) - 1)]
            found += [grams[begin[k] : begin[k + 1]] for k in range(len(begin) - 1)]
        gram = np.concatenate([*found, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        place = np.concatenate([*(np.arange(len(g)) for g in found), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.lexsort((place, item, gram))
        gram, item, place = gram[order], item[order], place[order]
        new = np.append(True, (np.diff(gram) != 0) | (np.diff(item) != 0))[: len(gram)]
        self.item, self.low, self.high = item[new], place[new], place[np.append(new[1:], True)[: len(gram)]]
        self.seeds, begin = np.unique(gram[new], return_index=True)
        self.begin = np.append(begin, len(self.item))


def found_in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x whose value is among the sorted ones, and which one it is."""
    if not len(sorted_values) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    at = np.flatnonzero(sorted_values[p] == x)
    return at, p[at]


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best Smith-Waterman score with linear gaps, and where it ends in the passage."""
    ramp = -GAP * np.arange(len(passage))
    above, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        h = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        h = np.maximum(np.maximum.accumulate(np.maximum(h, 0) + ramp) - ramp, 0)
        above[1:] = h
        if h.max() > best:
            best, end = float(h.max()), int(h.argmax()) + 1
    return best, end


def best_passage(item: np.ndarray, row: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """Score (0 to 1) and first and last word + 1 of the best passage around seeds: at in the row, low to high in the item.

    A passage of ``min_score`` has at most ``edits`` words beside the item's, so it lies within that reach of its seeds."""
    best = (0.0, 0, 0)
    n, order = len(item), np.argsort(at, kind="stable")
    at, low, high = at[order], low[order], high[order]
    edits = int((1 - settings.min_score) * MATCH * n / -GAP)
    for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > n + edits) + 1):
        lo = max(0, int((at[group] - high[group]).min()) - edits)
        hi = min(len(row), int((at[group] - low[group]).max()) + n + edits)
        passage = row[lo:hi]
        if np.isin(item, passage).sum() < settings.min_score * n:  # no more words than these can match
            continue
        score, end = local_alignment(item, passage)
        if score / (MATCH * n) > best[0]:
            _, back = local_alignment(item[::-1], passage[:end][::-1])
            best = (score / (MATCH * n), lo + end - back, lo + end)
    return best


def leak_finder(items, settings: Settings):
    """A UDF: of each text, the items of the block that it holds: (index, score, start, stop in UTF-8 bytes)."""

    @F.arrow_udf("array<struct<item: int, score: double, start: long, stop: long>>")
    def find(text: pa.Array) -> pa.Array:
        keep_only("folded", B.forget_words)
        block: Items = items.value
        rows: list[list[dict]] = []
        for hashes, start, end, first, offsets in words_of(text):
            grams, begin = B.gram_hashes(hashes, first, settings.words)
            hit, seed = found_in(block.seeds, grams)
            out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
            if len(hit):
                row = np.searchsorted(begin, hit, side="right") - 1
                times = block.begin[seed + 1] - block.begin[seed]
                source = np.repeat(block.begin[seed] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                row, at = np.repeat(row, times), np.repeat(hit - begin[row], times)
                item, low, high = block.item[source], block.low[source], block.high[source]
                order = np.lexsort((at, item, row))
                row, at, item, low, high = row[order], at[order], item[order], low[order], high[order]
                for g in np.split(np.arange(len(row)), np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1):
                    r, i = int(row[g[0]]), int(item[g[0]])
                    score, lo, hi = best_passage(block.sequences[i], hashes[first[r] : first[r + 1]], at[g], low[g], high[g], settings)
                    if score >= settings.min_score:
                        out[r].append({"item": i, "score": round(score, 6), "start": int(start[first[r] + lo] - offsets[r]), "stop": int(end[first[r] + hi - 1] - offsets[r])})
            rows += out
        return pa.array(rows, pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])))

    return find


def item_blocks(benchmark: DataFrame, settings: Settings, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks of about ``block_bytes``."""
    rows = benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull())
    total = rows.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    blocks = max(1, -(-total // settings.block_bytes))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == k).orderBy(item_col, text_col).collect()  # a block's worth of bytes
        if part:
            yield [r[0] for r in part], [r[1] for r in part]


def finders(docs: DataFrame, benchmark: DataFrame, settings: Settings, item_col: str, item_text: str, text_col: str) -> Iterator[tuple[list, object]]:
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    for ids, texts in item_blocks(benchmark, settings, item_col, item_text):
        yield ids, leak_finder(docs.sparkSession.sparkContext.broadcast(Items(texts, settings.words)), settings)


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, start, stop: the best passage of each item that a row holds, with a score of
    ``min_score`` at least; start and stop are UTF-8 bytes of the text.

    Null and empty texts and items hold nothing; an item of fewer words than a seed has is found only in texts of just
    those words. Repeated rows and items give repeated results; null ids are kept."""
    spark = docs.sparkSession
    out = None
    for ids, find in finders(docs, benchmark, settings, item_col, item_text, text_col):
        names = spark.createDataFrame(list(enumerate(ids)), f"_item int, item_id {benchmark.schema[item_col].dataType.simpleString()}")
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(find(F.col(text_col))).alias("f"))
        found = found.join(F.broadcast(names), F.col("f.item") == F.col("_item")).select("doc_id", "item_id", "f.score", "f.start", "f.stop")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).selectExpr("doc_id", f"cast(null as {benchmark.schema[item_col].dataType.simpleString()}) as item_id", "0d as score", "0L as start", "0L as stop")
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Null and empty texts and null ids stay; repeated rows are judged alike; an item that is null or empty is in no text;
    texts are read whole, however long; an empty table stays empty, and an empty benchmark leaves all rows."""
    out = docs
    for _, find in finders(docs, benchmark, settings, item_col, item_text, text_col):
        (f,) = free_name(out, "found")
        out = out.withColumn(f, find(F.col(text_col))).where(F.size(F.col(f)) == 0).drop(f)
    return out.select(*docs.columns)
