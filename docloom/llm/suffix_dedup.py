"""Removal of long repeated substrings through column-wise suffix sorting of document collections.

Matches are strings of ``length`` bytes that start at two places. Equal strings have the same anchor (their least
32-gram by hash) at the same place, so only strings of one anchor can match, and each document falls into runs of
strings with one anchor occurrence. Runs whose anchor occurs nowhere else hold no match. Runs that are equal as a whole
(by the anchor's hash and 126 bits of unlike ones) are repeated as a whole, and one of them goes on. What is left of an
anchor's runs is cut to the context that some other run shares on each side; these segments are the documents of a
collection whose Burrows-Wheeler transform and common prefixes are built column by column from the right end, one symbol
of each segment in each round. A common prefix of ``length`` with a neighbour marks a repeated string.

A collection over whole documents would take as many global rounds as the longest document has bytes; segments have
less than two lengths, so rounds are few, and since anchors part the matches, every task builds its own collections of
bounded size. Their sequential files are arrays in memory, written anew each round. An anchor of more than ``most``
different segments is parted further: its strings form runs of fewer starts, and all bytes that a run's strings share
are the new anchor, in steps down to runs of one string. Equal strings stay together at each step, so the result is the
same at any size, and no collection is larger than ``most``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _bytes as B
from docloom.llm._anchors import KGRAM, StringHashes, anchors
from docloom.llm._bloom import may_be_in
from docloom.llm._bwt import Collection, common
from docloom.llm._shared import free_name, frugal, remove, ship_package, small_batches, staged

LENGTH = 400
#: Different segments of one anchor that a collection takes, segments to a collection, bytes looked at together.
MOST, TOGETHER, SECTION = 12_000, 1024, 1 << 18
#: Starts in a run of an anchor that has more than MOST segments, step by step.
WIDTHS = (64, 8, 1)
RUN = "row long, crc long, first long, last long, at long, anchor long, whole long, more long"
SEGMENT = "anchor long, row long, crc long, first long, at long, copies long, hot boolean, bytes binary"
PART = "anchor long, whole long, more long, row long, crc long, first long, last long, at long, copies long, bytes binary"
SPAN = "row long, crc long, lo long, hi long"


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def text_key(text: F.Column) -> list[F.Column]:
    """What tells texts apart: two unlike hashes."""
    return [F.xxhash64(text).alias("row"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc")]


def find_runs(length: int):
    """Of (row, crc, text): rows of RUN: its strings' first and last start, its anchor's place and hash, and hashes of
    all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(2))
            keys, parts, size = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], [], 0
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                for lo in range(0, max(len(text) - length + 1, 0), SECTION):
                    part = text[lo : lo + SECTION + length - 1]
                    hashes = StringHashes(part)
                    h, at, first, last = anchors(part, length, hashes.plain)
                    whole, more = hashes.of(first, last + length)
                    whole = B.mix(whole + (at - first).astype(np.uint64))
                    parts.append((*(np.full(len(h), k[i]) for k in keys), first + lo, last + lo, at + lo, h.view(np.int64), whole.view(np.int64), more))
                    size += len(h)
                if size > 20_000:
                    yield _batch(parts, names_of(RUN))
                    parts, size = [], 0
            if parts:
                yield _batch(parts, names_of(RUN))

    return run


def _batch(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(len(names))], names=names)


def cut_segments(length: int):
    """Of (row, crc, text, runs): the bytes of each run's strings, as SEGMENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, crc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                out += [(r["anchor"], row, crc, r["first"], r["at"] - r["first"], r["copies"], r["hot"], raw[r["first"] : r["last"] + length]) for r in runs]
            types = [*[pa.int64()] * 6, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names_of(SEGMENT))

    return run


def split_runs(length: int, width: int):
    """Of segments (anchor, row, crc, first, at, copies, bytes): PART rows of runs of ``width`` starts, by their distance
    from the anchor; the new anchor is all that any such run's strings share. Runs of one start come without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[pa.int64()] * 9, pa.binary()]
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            for anchor, row, crc, first, at, copies, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                data = np.frombuffer(raw, np.uint8)
                starts = np.arange(len(data) - length + 1)
                block = (at - starts) // width
                cut = np.flatnonzero(np.diff(block)) + 1
                lo, hi = np.append(0, cut), np.append(cut, len(starts)) - 1
                core = at - block[lo] * width
                hashes = StringHashes(data)
                named, _ = hashes.of(core, core + length - width + 1)
                key = B.mix(named + B.mix(np.array([anchor], np.int64).view(np.uint64) + B.mix(block[lo].astype(np.uint64))))
                whole, more = hashes.of(lo, hi + length)
                whole = B.mix(whole + (core - lo).astype(np.uint64))
                n = len(lo)
                for c, x in zip(columns, (key.view(np.int64), whole.view(np.int64), more, [row] * n, [crc] * n, lo + first, hi + first, core - lo, [copies] * n, [None if width == 1 else raw[a : b + length] for a, b in zip(lo, hi, strict=True)]), strict=True):
                    c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_of(PART))

    return run


def shared_context(contexts: list[bytes]) -> list[int]:
    """How long a prefix each has in common with one of the others: with a neighbour in sorted order."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    out = [0] * len(contexts)
    for a, b in zip(order, order[1:], strict=False):
        n = common(contexts[a], contexts[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def trimmed(group: list[tuple], length: int, core: int) -> list[list]:
    """Of an anchor's segments (row, crc, first, at, copies, bytes): [bytes, anchor's place in them, owners (row, crc,
    start of the bytes in the row, copies)] of what can hold a repeated string, equal ones together. core: the anchor's length."""
    left = shared_context([g[5][: g[3]][::-1] for g in group])
    right = shared_context([g[5][g[3] + core :] for g in group])
    found: dict[tuple[bytes, int], list] = {}
    for (row, crc, first, at, copies, raw), lo, hi in zip(group, left, right, strict=True):
        start, stop = at - lo, at + core + hi
        if stop - start >= length:
            found.setdefault((raw[start:stop], at - start), []).append((row, crc, first + start, copies))
    return [[raw, at, owners] for (raw, at), owners in found.items()]


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that strings at these starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist(), strict=True))


def sort_collections(length: int, core: int):
    """Of segments (anchor, row, crc, first, at, copies, bytes) sorted by anchor: (row, crc, lo, hi) covered by repeated strings."""

    def solve(groups: list[list[list]]) -> list[tuple[int, int, int, int]]:
        out = []
        several = []
        for segments in groups:
            for raw, _, owners in segments:
                if len(owners) > 1:
                    out += [(row, crc, lo, lo + len(raw)) for row, crc, lo, copies in owners if copies == 1]
            if len(segments) > 1:
                several += segments
        if several:
            starts = Collection([raw for raw, _, _ in several], [at for _, at, _ in several]).repeated(length)
            for (_, _, owners), s in zip(several, starts, strict=True):
                spans = spans_of(s, length)
                out += [(row, crc, lo + a, lo + b) for row, crc, lo, copies in owners if copies == 1 and len(owners) == 1 for a, b in spans]  # else covered already
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, anchor, group = [], 0, None, []
        for batch in batches:
            for key, *segment in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if key != anchor:
                    if group:
                        groups.append(trimmed(group, length, core))
                        size += len(groups[-1])
                    anchor, group = key, []
                    if size >= TOGETHER:
                        if found := solve(groups):
                            yield _batch([tuple(np.array(c) for c in zip(*found, strict=True))], names_of(SPAN))
                        groups, size = [], 0
                group.append(segment)
        if group:
            groups.append(trimmed(group, length, core))
        if found := solve(groups):
            yield _batch([tuple(np.array(c) for c in zip(*found, strict=True))], names_of(SPAN))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST, text_col: str = "text") -> DataFrame:
    """(row, crc, lo, hi): byte ranges of the texts (text_key) covered by strings of ``length`` bytes that also start
    elsewhere. Ranges may overlap and repeat."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    keyed = docs.where(F.octet_length(text_col) >= length).select(*text_key(F.col(text_col)), F.col(text_col).alias("text"))
    runs, runs_path = staged(keyed.mapInArrow(frugal(find_runs(length)), RUN), "runs")
    several, several_path = staged(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    alive, alive_path = staged(runs.join(several, "anchor", "left_semi"), "alive")
    remove(spark, runs_path, several_path)
    name = ["anchor", "whole", "more"]
    owner = ["row", "crc", "first", "last", "at"]
    different, path = staged(alive.groupBy(*name).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*owner)).alias("r")), "different-runs")
    span = [F.col("row"), F.col("crc"), F.col("first").alias("lo"), (F.col("last") + length).alias("hi")]
    covered, _ = staged(alive.join(different.where("copies > 1").select(*name), name, "left_semi").select(*span).distinct(), "covered")
    remove(spark, alive_path)

    mixed = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    chosen = different.join(mixed, "anchor").select("r.row", "r.crc", F.struct("anchor", *(F.col(f"r.{c}").alias(c) for c in ("first", "last", "at")), "copies", (F.col("d") > most).alias("hot")).alias("run"))
    by_row = chosen.groupBy("row", "crc").agg(F.collect_list("run").alias("runs"))  # of one text
    cut = keyed.join(by_row, ["row", "crc"]).select("row", "crc", "text", "runs").mapInArrow(frugal(cut_segments(length)), SEGMENT)
    segments, segments_path = staged(cut.dropDuplicates(["row", "crc", "first"]), "segments")
    remove(spark, path)
    columns = ["anchor", "row", "crc", "first", "at", "copies", "bytes"]

    def sorted_spans(cold: DataFrame, core: int) -> DataFrame:
        rows = cold.select(*columns).repartition("anchor").sortWithinPartitions("anchor", "row", "crc", "first")
        return staged(rows.mapInArrow(frugal(sort_collections(length, core)), SPAN), "covered")[0]

    covered = covered.unionByName(sorted_spans(segments.where("not hot"), KGRAM))
    hot = segments.where("hot")
    for width in (w for w in WIDTHS if w < length):
        if hot.isEmpty():
            break
        parts, parts_path = staged(hot.select(*columns).mapInArrow(frugal(split_runs(length, width)), PART), "parts")
        remove(spark, segments_path)
        one, one_path = staged(parts.groupBy(*name).agg(F.sum("copies").alias("copies"), F.min(F.struct(*owner, "bytes")).alias("r")), "different-parts")
        again = one.where("copies > 1").select(*name)
        equal, _ = staged(parts.where("copies = 1").join(again, name, "left_semi").select(*span).distinct(), "covered")
        remove(spark, parts_path)
        covered = covered.unionByName(equal)
        counts = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1")  # none if runs are single strings
        segments, segments_path = staged(one.join(counts, "anchor").select("anchor", "r.row", "r.crc", "r.first", "r.at", "copies", "r.bytes", (F.col("d") > most).alias("hot")), "segments")
        remove(spark, one_path)
        if width > 1:
            covered = covered.unionByName(sorted_spans(segments.where("not hot"), length - width + 1))
        hot = segments.where("hot")
    remove(spark, segments_path)
    return covered


def merged(spans: DataFrame) -> DataFrame:
    """row, crc and spans: its covered ranges in order, those that touch or overlap made one."""
    before = "over (partition by row, crc order by lo, hi rows between unbounded preceding and 1 preceding)"
    opened = spans.withColumn("opens", F.expr(f"cast(coalesce(lo > max(hi) {before}, true) as int)"))
    islands = opened.withColumn("island", F.expr("sum(opens) over (partition by row, crc order by lo, hi rows unbounded preceding)"))
    ranges = islands.groupBy("row", "crc", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ranges.groupBy("row", "crc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


RESULT = "struct<kept: binary, kept_text: string, n_removed: long, n_spans: long>"


def cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the bytes in its spans, as bytes and as text, what went and in how many ranges."""
    out = []
    for t, s in zip(text, spans, strict=True):
        raw = (t.as_py() or "").encode()
        ranges = s.as_py() or []
        at = [0, *(x for r in ranges for x in (r["lo"], r["hi"])), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
        out.append((kept, kept.decode("utf-8", "ignore"), len(raw) - len(kept), len(ranges)))
    types = (pa.binary(), pa.string(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["kept", "kept_text", "n_removed", "n_spans"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, most: int = MOST, text_col: str = "text") -> DataFrame:
    """``docs`` with kept (binary: the bytes that stay), kept_text (they as text, without the rest of characters that
    were cut), n_bytes (before), n_removed and n_spans (maximal removed ranges).

    Each byte goes that a string of ``length`` bytes covers which also starts elsewhere in any text, judged on the
    input; copies lose all such bytes. Null text is empty; texts under ``length`` bytes stay whole; repeated rows are
    copies; an empty table stays empty; columns of these names are replaced. Very long texts are looked at in
    overlapping sections, whole. Only rows whose text may have lost bytes are joined with their ranges."""
    new = ["kept", "kept_text", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*new)
    ranges, _ = staged(merged(repeated_spans(docs, length, most, text_col)), "ranges")
    maybe = may_be_in(ranges.select("row"))
    row, crc, spans, done, m = free_name(docs, "row", "crc", "spans", "done", "maybe")
    keys = text_key(F.col(text_col))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(whole).cast("long").alias("n_bytes")
    marked = docs.withColumn(m, maybe(keys[0]))
    none = F.lit(0).cast("long")
    untouched = marked.where(~F.col(m)).select(*docs.columns, whole.cast("binary").alias("kept"), whole.alias("kept_text"), size, none.alias("n_removed"), none.alias("n_spans"))
    asked = marked.where(F.col(m)).withColumns({row: keys[0], crc: keys[1]})
    joined = asked.join(ranges.select(F.col("row").alias(row), F.col("crc").alias(crc), F.col("spans").alias(spans)), [row, crc], "left")
    cut = joined.withColumn(done, F.arrow_udf(cut_out, RESULT)(F.col(text_col), F.col(spans)))
    return untouched.unionByName(cut.select(*docs.columns, F.col(f"{done}.kept").alias("kept"), F.col(f"{done}.kept_text").alias("kept_text"), size, F.col(f"{done}.n_removed").alias("n_removed"), F.col(f"{done}.n_spans").alias("n_spans")))
