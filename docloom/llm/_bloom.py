"""A Bloom filter of bounded size over 64-bit hashes, to keep rows that can't meet a join from being shuffled for it.

It has no false negatives and decides nothing by itself: rows that pass it still go through the exact join. Its size is
fixed, so with very many keys it lets more rows pass and costs a shuffle, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import mix
from docloom.llm._shared import gathered, ship_package

#: Binary logarithm of the filter's bits: 4 MB, which go to the driver and to each task.
BITS = 25


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(hashes.view(np.uint64))
    low = np.uint64((1 << bits) - 1)
    return (x & low).astype(np.int64), (x >> np.uint64(32) & low).astype(np.int64)


def among(words: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be among those that filled ``words``."""
    a, b = places(hashes, bits)
    bit = lambda at: words[at >> 6] >> (at & 63) & 1
    found = bit(a).astype(bool)
    some = np.flatnonzero(found)
    found[some] = bit(b[some])
    return found


def filled(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter's words for ``keys`` (one column of long hashes, not null)."""
    ship_package(keys.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << bits - 6, np.int64)
        for b in gathered(batches, 50_000):
            for at in places(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63))
        at = np.flatnonzero(words)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part])], names=["at", "word"])

    found = keys.mapInArrow(fill, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[found["at"].to_numpy()] = found["word"].to_numpy()
    return table


def may_be_in(keys: DataFrame, bits: int = BITS):
    """Of ``keys`` (one column of long hashes, not null): a function from a column of hashes to whether each may be among them."""
    held = keys.sparkSession.sparkContext.broadcast(filled(keys, bits))

    @F.arrow_udf("boolean")
    def probe(column: pa.Array) -> pa.Array:
        return pa.array(among(held.value, column.to_numpy(zero_copy_only=False), bits))

    def passes(hash_column: Column) -> Column:
        return probe(hash_column)

    return passes
