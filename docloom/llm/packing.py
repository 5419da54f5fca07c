"""Best-fit packing of token sequences, planned over counts of lengths.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Best fit in order of falling length looks
only at how many pieces have each length: equal bins are handled as one run of bins, so the plan's work depends on
``capacity`` and not on the number of documents. The plan says which ranks of a length go to which run of bins. Pieces
then learn their rank within their length (counted in salted groups, so a length that many pieces share is no single
task's work) and take the planned place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import row_blocks, text_buffers
from docloom.llm._shared import frugal, ship_package, small_batches, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that one task ranks.
RANKED = 50_000


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first rank, first bin, pieces to a bin, offset in the bin) in order of rank.

    From first rank on, pieces fill bins one after the other, the given number in each. Best fit: the fullest bins
    that have room come first, and a bin that still has room after a piece is the fullest of all."""
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: runs (first bin, bins)
    rooms: list[int] = []
    bins = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, entries = counts[length], 0, []
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                r, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                r = rooms[i]
                each = r // length
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[i]
            took = min(left, n * each)
            full, rest = divmod(took, each)
            entries.append((rank, first, each, capacity - r))
            put(r - each * length, first, full)
            if rest:
                put(r - rest * length, first + full, 1)
            put(r, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + took, left - took
        plan[length] = entries
    return plan


def encoded_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES of each document, with ids (array of int) if asked for."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def batch(doc, piece, start, n, crc, ids) -> pa.RecordBatch:
        columns = [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm._tokens import unit_tokenizer

        tokenizer, end = unit_tokenizer(tokenizer_path), np.array([end_id], "<u4")
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for i, j in row_blocks(offsets):
                flat, begin = tokenizer.ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of, piece, start, n, crc, kept = [], [], [], [], [], []
                for k in range(j - i):
                    ids = np.concatenate([flat[begin[k] : begin[k + 1]].astype("<u4"), end])
                    for p in range(0, len(ids), capacity):
                        x = ids[p : p + capacity]
                        of.append(i + k), piece.append(p // capacity), start.append(p), n.append(len(x)), crc.append(zlib.crc32(x.tobytes()))
                        if keep_ids:
                            kept.append(x)
                yield batch(b.column(0).take(pa.array(of, pa.int64())), piece, start, n, crc, kept)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(frugal(run, "tokenizer"), PIECES + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document's ids are its whole text's and then ``end_id``; null text is empty, so every document has a piece. Only
    documents over ``capacity`` are cut. Repeated rows are packed as often as they occur; null ids are kept; an empty
    table gives an empty result; other columns are left out."""
    spark = docs.sparkSession
    pieces, _ = staged(encoded_pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = best_fit_plan(counts, capacity)
    rows = [(n, -(-counts[n] // RANKED), entries) for n, entries in plan.items()]
    table = spark.createDataFrame(rows, "length long, salts long, entries array<struct<first: long, bin: long, each: long, at: long>>")
    salted = pieces.join(F.broadcast(table.select("length", "salts")), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), salts)"))
    before = salted.groupBy("length", "salt").count().selectExpr("length", "salt", "sum(count) over (partition by length order by salt) - count as before")
    ranked = salted.withColumn("place", F.expr("row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1"))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    placed = ranked.join(F.broadcast(table.select("length", "entries")), "length")
    placed = placed.withColumn("slot", F.expr("array_max(filter(entries, e -> e.first <= rank))")).withColumn("in_slot", F.expr("rank - slot.first"))
    sequence, offset = F.expr("slot.bin + in_slot div slot.each"), F.expr("slot.at + (in_slot % slot.each) * length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, sequence.alias("sequence_id"), offset.alias("offset"))
