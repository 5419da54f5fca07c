"""Exact dedup through a sharded cuckoo-filter index of live digests.

A digest (SHA-256 of the text, A-Z lower-cased) belongs to one shard. A shard has a cuckoo filter (16-bit fingerprints,
four slots a bucket) and, bucketed beside it, the content that the filter stands for: digest, the row that stays and
how many rows share it. An insertion first asks the filter; only a hit is looked up in the content, which tells a copy
from a false positive. A full filter is doubled and filled again from the stored digests. Deletion takes the
fingerprint of a live digest out again.

Rows are combined inside each input partition before they are dealt to shards, so a digest that a third of all rows
share reaches its shard as a few entries for each partition. The number of shards follows the number of rows, and
shards are split when insertions let them grow, so a shard stays small at any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bloom import may_be_in
from docloom.llm._shared import LOWER, UPPER, free_name, remove, ship_package, staged

FILTER, STORED, INSERT, DELETE = range(4)
SCHEMA = "shard int, kind int, digest string, keep_id long, n_keep long, group_size long, slots binary"
FIELDS = ["shard", "kind", "digest", "keep_id", "n_keep", "group_size", "slots"]
ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("digest", pa.string()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("group_size", pa.int64()), ("slots", pa.binary())])
#: Entries that a map task combines before it passes them on.
COMBINE = 100_000


class CuckooFilter:
    """Partial-key cuckoo hashing: a fingerprint's other bucket follows from the fingerprint and its bucket alone."""

    SLOTS, KICKS = 4, 400

    def __init__(self, buckets: int, slots: bytes | None = None) -> None:
        self.mask = buckets - 1
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(buckets, self.SLOTS).copy()
        self.kick = 0

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * cls.SLOTS * 0.9 < max(keys, 1):
            buckets *= 2
        return cls(buckets)

    @classmethod
    def filled(cls, keys: Iterable[str]) -> CuckooFilter:
        keys = list(keys)
        out = cls.sized(len(keys) + 1)
        return out if all(out.insert(k) for k in keys) else out.resized(keys)

    def place(self, digest: str) -> tuple[int, int, int]:
        mark = int(digest[16:20], 16) or 1
        i = int(digest[:16], 16) & self.mask
        return mark, i, self.other(i, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def __contains__(self, digest: str) -> bool:
        mark, i, j = self.place(digest)
        return bool((self.table[i] == mark).any() or (self.table[j] == mark).any())

    def insert(self, digest: str) -> bool:
        """False if no slot was found: the filter has overflowed and one fingerprint has no place."""
        mark, i, j = self.place(digest)
        for b in (i, j):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        b = i
        for _ in range(self.KICKS):
            self.kick = (self.kick + 1) % self.SLOTS
            mark, self.table[b, self.kick] = int(self.table[b, self.kick]), mark
            b = self.other(b, mark)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        return False

    def delete(self, digest: str) -> bool:
        mark, i, j = self.place(digest)
        for b in (i, j):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def resized(self, keys: Iterable[str]) -> CuckooFilter:
        """At least twice as large, filled again from the stored digests."""
        keys, buckets = list(keys), 2 * (self.mask + 1)
        while True:
            out = CuckooFilter(buckets)
            if all(out.insert(k) for k in keys):
                return out
            buckets *= 2


class Shard:
    """One shard's filter and content while a batch is applied to it."""

    def __init__(self, filter_: CuckooFilter, content: dict[str, list]) -> None:
        self.filter, self.content = filter_, content

    def insert(self, digest: str, keep: tuple, size: int) -> None:
        """keep: (the largest doc_id or None, how many rows have it)."""
        if digest in self.filter and (found := self.content.get(digest)) is not None:
            found[0] = larger(found[0], keep)
            found[1] += size
            return
        self.content[digest] = [keep, size]
        if not self.filter.insert(digest):
            self.filter = self.filter.resized(self.content)

    def delete(self, digest: str) -> None:
        if digest in self.filter and digest in self.content:
            self.filter.delete(digest)
            del self.content[digest]


def larger(a: tuple, b: tuple) -> tuple:
    if a[0] == b[0]:
        return a[0], a[1] + b[1]
    return a if b[0] is None or (a[0] is not None and a[0] > b[0]) else b


def combine(shards: int):
    """Entries of a partition, a digest once for each COMBINE digests seen."""

    def flush(seen: dict) -> pa.RecordBatch:
        rows = [(int(d[20:28], 16) % shards, INSERT, d, keep[0], keep[1], size, None) for d, (keep, size) in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW.field(i).type) for i in range(len(ARROW))], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for b in batches:
            for digest, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (found := seen.get(digest)) is None:
                    seen[digest] = [(doc, 1), 1]
                else:
                    found[0] = larger(found[0], (doc, 1))
                    found[1] += 1
            if len(seen) >= COMBINE:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    return run


def apply_batch(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in FIELDS), strict=True), key=lambda r: r[1])
    content = {r[2]: [(r[3], r[4]), r[5]] for r in rows if r[1] == STORED}
    old = next((r[6] for r in rows if r[1] == FILTER), None)
    shard = Shard(CuckooFilter(len(old) // 8, old) if old else CuckooFilter.filled(content), content)
    for r in rows:
        if r[1] == INSERT:
            shard.insert(r[2], (r[3], r[4]), r[5])
        elif r[1] == DELETE:
            shard.delete(r[2])
    key = rows[0][0]
    out = [(key, FILTER, None, None, None, None, shard.filter.table.tobytes())]
    out += [(key, STORED, d, keep[0], keep[1], size, None) for d, (keep, size) in shard.content.items()]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], ARROW.field(i).type) for i in range(len(ARROW))], schema=ARROW)


def shard_of(digest: F.Column, shards: int) -> F.Column:
    return (F.conv(F.substring(digest, 21, 8), 16, 10).cast("long") % shards).cast("int")


class CuckooIndex:
    """The index as a table of SCHEMA in the shared folder; each change writes a new version of it. ``rows`` bounds the
    number of live digests from above."""

    def __init__(self, table: DataFrame, path: str, shards: int, rows: int = 0, shard_rows: int = 20_000) -> None:
        self.table, self.path, self.shards, self.rows, self.shard_rows = table, path, shards, rows, shard_rows

    @classmethod
    def build(cls, digests: DataFrame, shard_rows: int = 20_000) -> CuckooIndex:
        """Of rows (digest, doc_id)."""
        return cls(digests.sparkSession.createDataFrame([], SCHEMA), "", 1, 0, shard_rows).insert(digests)

    def _applied(self, entries: DataFrame, table: DataFrame, shards: int, rows: int) -> CuckooIndex:
        out, path = staged(table.unionByName(entries).groupBy("shard").applyInArrow(apply_batch, SCHEMA), "cuckoo")
        return CuckooIndex(out, path, shards, rows, self.shard_rows)

    def insert(self, digests: DataFrame) -> CuckooIndex:
        """The index with rows (digest, doc_id) added; copies of a live digest raise its count. Where shards would grow
        to twice their size, stored digests are dealt to more shards, whose filters are filled from them."""
        ship_package(digests.sparkSession)
        rows = self.rows + digests.count()
        table, shards = self.table, self.shards
        if rows > 2 * shards * self.shard_rows or not self.rows:
            shards = max(1, -(-rows // self.shard_rows))
            table = table.where(F.col("kind") == STORED).withColumn("shard", shard_of(F.col("digest"), shards))
        return self._applied(digests.select("digest", "doc_id").mapInArrow(combine(shards), SCHEMA), table, shards, rows)

    def delete(self, digests: DataFrame) -> CuckooIndex:
        """The index without these digests (digest); what isn't live is passed over."""
        none = {c: F.lit(None) for c in ("keep_id", "n_keep", "group_size", "slots")}
        gone = digests.select(shard_of(F.col("digest"), self.shards).alias("shard"), F.lit(DELETE).alias("kind"), "digest").distinct().withColumns(none)
        typed = gone.selectExpr("shard", "kind", "digest", "cast(keep_id as long) keep_id", "cast(n_keep as long) n_keep", "cast(group_size as long) group_size", "cast(slots as binary) slots")
        return self._applied(typed, self.table, self.shards, self.rows)

    def content(self) -> DataFrame:
        """digest, keep_id, n_keep (rows that have keep_id), group_size of each live digest."""
        return self.table.where(F.col("kind") == STORED).select("digest", "keep_id", "n_keep", "group_size")

    def drop(self) -> None:
        remove(self.table.sparkSession, self.path)


def text_digest(text: F.Column) -> F.Column:
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "UTF-8"), 256)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Null text counts as empty. Of equal texts the row with the largest id stays (a null id is the smallest); of several
    rows that share text and id one stays. Very long texts count whole. Other columns, whatever their names, aren't
    looked at; an empty table gives an empty result."""
    rows, _ = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    index = CuckooIndex.build(rows)
    repeated, _ = staged(index.content().where("group_size > 1"), "repeated")
    several = not repeated.where("n_keep > 1").isEmpty()
    index.drop()
    joined = rows.join(repeated, "digest", "left")
    stays = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = joined.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), stays.alias("kept"), F.col("digest").alias("text_sha256"), "n_keep")
    if several:  # rows that repeat both text and id: one of them stays
        first = out.where("kept and n_keep > 1").withColumn("kept", F.expr("row_number() over (partition by text_sha256 order by doc_id) = 1"))
        out = out.where("not (kept and coalesce(n_keep, 1) > 1)").unionByName(first)
    return out.drop("n_keep")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts (null counts as empty) the one with the
    largest id, null being the smallest; of rows that share text and id one. An empty table stays empty.

    Only rows whose id may be that of a copy that goes are compared with the index; all others pass as they are."""
    digests, digests_path = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    index = CuckooIndex.build(digests)
    repeated, _ = staged(index.content().where("group_size > 1").select("digest", "keep_id", "n_keep"), "repeated")
    index.drop()
    copies = digests.join(repeated, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")) | (F.col("n_keep") > 1))
    maybe = may_be_in(copies.select(F.xxhash64("doc_id")))
    several = not repeated.where("n_keep > 1").isEmpty()
    remove(docs.sparkSession, digests_path)
    d, k, n, m = free_name(docs, "digest", "keep_id", "n_keep", "maybe")
    marked = docs.withColumn(m, maybe(F.xxhash64(F.col(id_col).cast("long"))))
    found = marked.where(F.col(m)).withColumn(d, text_digest(F.col(text_col))).join(repeated.select(F.col("digest").alias(d), F.col("keep_id").alias(k), F.col("n_keep").alias(n)), d, "left")
    stays = found.where(F.col(n).isNull() | F.col(id_col).cast("long").eqNullSafe(F.col(k)))
    if several:  # rows that repeat both text and id
        stays = stays.where(F.coalesce(F.col(n), F.lit(1)) == 1).unionByName(stays.where(F.col(n) > 1).dropDuplicates([d]))
    return marked.where(~F.col(m)).select(*docs.columns).unionByName(stays.select(*docs.columns))
