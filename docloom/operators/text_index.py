"""A written inverted index for BM25: segments of posting blocks, with bounds that let searches skip blocks.

A segment is a batch of documents, committed as a whole. Its documents are ordered by language and length, so that what
is alike stands together, and cut into blocks of BLOCK. A row of postings is one token in one block: the documents' ids,
the token's count in each and their lengths, with the largest count and the smallest length, which bound every score that
the token can give in the block, whatever statistics later segments bring. A block that two tasks write may have two rows of
a token, of other documents each; their bounds add up, which is a bound still.

A search adds these bounds up for each query and block, scores each query's most promising blocks, and takes the k-th best
score found as the bar: blocks whose bound is under it hold no result and are never scored. Results are those of
``search.bm25``, to the bit.

Documents that come again in a later segment, or are deleted, are passed over in older ones: deletions are a table of
their own, and segments are never changed. ``merge`` writes live documents of several segments as one and retires those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import search_tokens
from docloom.operators.search import HIT_CELLS, K1, B, ranked
from docloom.sources.stage import small_batches, staged, work_path
from docloom.sources.store import commit_batch, read_committed

#: Documents of a block; blocks of a query that are scored to set its bar, for each result wanted.
BLOCK, FIRST = 32, 2
ROW = "token string, block long, ids array<long>, tfs array<long>, lengths array<long>, most long, least long"
PACKED = "segment long, block long, words string, counts array<int>, ids array<long>, places array<int>, tfs array<int>, news array<long>, lengths array<long>"


def impact(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    """A token's part of a score in millionths, as ``search.bm25`` has it. It grows with tf and falls with length."""
    return F.floor(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) * 1e6 + 0.5)


def _lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, _by, length, and each token once (words) with its count (tfs), from doc_id, _by, tokens."""
    for b in batches:
        lengths = _numbers(b.column(2).value_lengths()).astype(np.int64)
        words = b.column(2).flatten().dictionary_encode()
        row, n = np.repeat(np.arange(b.num_rows), lengths), max(1, len(words.dictionary))
        pairs, tf = np.unique(row * n + _numbers(words.indices), return_counts=True)
        row, word = np.divmod(pairs, n)
        ends = np.searchsorted(row, np.arange(b.num_rows + 1))
        joined = pc.binary_join(_lists(ends, words.dictionary.take(pa.array(word))), " ")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths), joined, _lists(ends, tf.astype(np.int32))], names=["doc_id", "_by", "length", "words", "tfs"])


def _one_row(counted: DataFrame) -> DataFrame:
    """Rows of ``_term_counts`` of the same document as one."""
    whole = counted.groupBy("doc_id").agg(F.min("_by").alias("_by"), F.sum("length").alias("length"))
    each = counted.where("length > 0").select("doc_id", F.explode(F.arrays_zip(F.split("words", " ").alias("word"), "tfs")).alias("t"))
    terms = each.groupBy("doc_id", "t.word").agg(F.sum("t.tfs").cast("int").alias("tf"))
    lists = terms.groupBy("doc_id").agg(F.collect_list(F.struct("word", "tf")).alias("t"))  # a document's tokens
    words, tfs = F.coalesce(F.array_join("t.word", " "), F.lit("")), F.coalesce("t.tf", F.array().cast("array<int>"))
    return whole.join(lists, "doc_id", "left").select("doc_id", "_by", "length", words.alias("words"), tfs.alias("tfs"))


class Terms:
    """Occurrences (token, block, document, count, length) that wait until their block is whole."""

    def __init__(self) -> None:
        self.held: list[tuple] = []

    def add(self, tokens: pa.Array, *numbers: np.ndarray) -> None:
        if len(tokens):
            self.held.append((tokens, *numbers))

    def rows(self, until: int | None) -> Iterator[pa.RecordBatch]:
        """Rows of the blocks with numbers under ``until``, of all if None; the others are held on."""
        if not self.held:
            return
        tokens = pa.concat_arrays([h[0] for h in self.held])
        numbers = [np.concatenate([h[i] for h in self.held]) for i in range(1, 5)]
        now = np.ones(len(tokens), bool) if until is None else numbers[0] < until
        self.held = []
        if not now.all():
            self.add(tokens.filter(pa.array(~now)), *(n[~now] for n in numbers))
        if not now.any():
            return
        words = tokens.filter(pa.array(now)).dictionary_encode()
        block, doc, tf, length = (n[now] for n in numbers)
        word = _numbers(words.indices)
        order = np.lexsort((doc, word, block))
        block, word, doc, tf, length = (x[order] for x in (block, word, doc, tf, length))
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (word[1:] != word[:-1])]))
        ends = np.append(first, len(block))
        columns = [words.dictionary.take(pa.array(word[first])), pa.array(block[first]), *(_lists(ends, x) for x in (doc, tf, length)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length, first))]
        out = pa.RecordBatch.from_arrays(columns, names=["token", "block", "ids", "tfs", "lengths", "most", "least"])
        yield from (out.slice(i, 1 << 14) for i in range(0, out.num_rows, 1 << 14))


def _block_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings from documents (block, doc_id, length, words, tfs) that come block by block."""
    terms = Terms()
    for b in batches:
        block, doc, length = (_numbers(b.column(i)) for i in range(3))
        each = np.repeat(np.arange(b.num_rows), _numbers(b.column(4).value_lengths()))
        some = b.column(3).filter(pc.not_equal(b.column(3), ""))  # splitting "" would give a token
        terms.add(pc.split_pattern(some, " ").flatten(), block[each], doc[each], _numbers(b.column(4).flatten()).astype(np.int64), length[each])
        if b.num_rows and block.min() == block[0]:
            yield from terms.rows(block[-1])
        else:  # another file's blocks
            yield from terms.rows(None)
    yield from terms.rows(None)


def _cuts(segment: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Beginnings and ends of runs of rows of one block."""
    first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (block[1:] != block[:-1])])) if len(block) else []
    return list(zip(first, [*first[1:], len(block)], strict=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's postings (segment, block, token, ids, tfs) as few rows of PACKED: its words, how many documents each has,
    the documents, and each posting's place among them."""
    for b in batches:
        segment, block, rows = _numbers(b.column(0)), _numbers(b.column(1)), []
        for i, j in _cuts(segment, block):
            ids, place = np.unique(_numbers(b.column(3).slice(i, j - i).flatten()), return_inverse=True)
            counts = _numbers(b.column(3).slice(i, j - i).value_lengths())
            rows.append((segment[i], block[i], " ".join(b.column(2).slice(i, j - i).to_pylist()), counts.astype(np.int32), ids, place.astype(np.int32), _numbers(b.column(4).slice(i, j - i).flatten()).astype(np.int32), None, None))
        kinds = [pa.int64(), pa.int64(), pa.string(), *(pa.list_(k()) for k in (pa.int32, pa.int64, pa.int32, pa.int32, pa.int64, pa.int64))]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["segment", "block", "words", "counts", "ids", "places", "tfs", "news", "lengths"])


def _moved_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in new blocks. Rows of PACKED come in order of segment and block; the first of a block, without words, has
    the ids, new blocks and lengths of its live documents."""
    terms, at, live, lists = Terms(), None, None, None
    for b in batches:
        for i, (segment, block) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            row = lambda c, i=i: _numbers(b.column(c).slice(i, 1).flatten())  # noqa: B023, E731
            if not b.column(2)[i].is_valid:
                at, live, lists = (segment, block), row(4), (row(7), row(8))
                order = np.argsort(live)
                live, lists = live[order], [x[order] for x in lists]
                yield from terms.rows(lists[0].min())
            elif at == (segment, block):  # otherwise none of the block's documents is live
                ids, words = row(4)[row(5)], np.repeat(np.arange(len(row(3))), row(3))
                place = np.minimum(np.searchsorted(live, ids), len(live) - 1)
                kept = live[place] == ids
                place = place[kept]
                terms.add(pa.array(b.column(2)[i].as_py().split(" ")).take(pa.array(words[kept])), lists[0][place], ids[kept], row(6)[kept].astype(np.int64), lists[1][place])
    yield from terms.rows(None)


def _block_scores(block: pa.Table) -> pa.Table:
    """query_id, doc_id, score from the postings of one block (queries, idf, mean, ids, tfs, lengths)."""
    block = block.combine_chunks()
    column = lambda name: block[name].chunk(0)
    n_queries, n_docs = (_numbers(column(name).value_lengths()).astype(np.int64) for name in ("queries", "ids"))
    each = np.repeat(np.arange(block.num_rows), n_docs)
    tf, length = (_numbers(column(name).flatten()) for name in ("tfs", "lengths"))
    part = np.floor(_numbers(column("idf"))[each] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / _numbers(column("mean"))[each])) * 1e6 + 0.5)
    docs, doc = np.unique(_numbers(column("ids").flatten()), return_inverse=True)
    asked = column("queries").flatten()
    queries, query = np.unique(_numbers(asked), return_inverse=True)
    score, hits, size = np.zeros(len(queries) * len(docs)), np.zeros(len(queries) * len(docs), np.int64), len(queries) * len(docs)
    first_query, first_doc, pairs = np.cumsum(n_queries) - n_queries, np.cumsum(n_docs) - n_docs, n_queries * n_docs
    cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // HIT_CELLS, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], block.num_rows], strict=True):
        row = np.repeat(np.arange(i, j), pairs[i:j])
        place = np.arange(len(row)) - np.repeat(np.cumsum(pairs[i:j]) - pairs[i:j], pairs[i:j])
        posting = first_doc[row] + place % n_docs[row]
        cell = query[first_query[row] + place // n_docs[row]] * len(docs) + doc[posting]
        score += np.bincount(cell, part[posting], size)
        hits += np.bincount(cell, minlength=size)
    found = np.flatnonzero(hits)
    return pa.table({"query_id": pa.array(queries[found // len(docs)], asked.type), "doc_id": docs[found % len(docs)], "score": score[found].astype(np.int64)})


class TextIndex:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or work_path(spark, "text-index")

    def add(self, docs: DataFrame, segment: int, order: str | None = None) -> bool:
        """Commits the documents (doc_id, text, and a column to ``order`` by) as a segment; False if it is there
        already. Segments have whole numbers, later ones larger ones; of a document that is in several, the last one
        counts. Null texts and those without a token have no row, but hide what older segments have of the document.
        Other segments aren't touched.

        A document's terms are counted in its row and go to its block as one row: no term is shuffled on its own."""
        small_batches(self.spark)
        by = (F.col(order) if order else F.lit(None)).cast("string")
        tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by.alias("_by"), search_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).where("doc_id is not null")
        counted = staged(tokens.mapInArrow(_term_counts, "doc_id long, _by string, length long, words string, tfs array<int>"), "term-counts")
        again = staged(counted.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
        if not again.isEmpty():
            counted = counted.join(again, "doc_id", "left_anti").unionByName(_one_row(counted.join(again, "doc_id", "left_semi")))
        place = ["_by", "length", "doc_id"]
        placed = counted.repartitionByRange(*place).sortWithinPartitions(*place)
        # consecutive numbers inside a part of the order: blocks never span two of them
        placed = staged(placed.select(F.floor(F.monotonically_increasing_id() / BLOCK).alias("block"), "doc_id", "length", "words", "tfs"), "blocks")
        return self._commit(placed.mapInArrow(_block_postings, ROW), placed.select("doc_id", "length", "block"), segment, self.spark.createDataFrame([], "retired long"))

    def _commit(self, postings: DataFrame, blocks: DataFrame, segment: int, retired: DataFrame) -> bool:
        return commit_batch({"postings": postings, "documents": blocks, "retired": retired}, self.path, str(segment))

    def delete(self, ids: DataFrame, after: int) -> bool:
        """Hides documents (doc_id) of the segments up to number ``after``; later ones may bring them again. Once for
        each number."""
        return commit_batch({"deleted": ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()}, f"{self.path}/deletions", str(after))

    def _read(self, name: str) -> DataFrame:
        found = read_committed(self.spark, self.path, name)
        if found is None:
            raise ValueError("the index has no segment")
        retired = read_committed(self.spark, self.path, "retired").select("retired").distinct()
        gone = [r.retired for r in retired.collect()]  # numbers of segments
        return found.withColumnRenamed("batch", "segment").where(~F.col("segment").isin(gone))

    def documents(self) -> DataFrame:
        """doc_id, segment, block, length, live: whether the row counts, of each document of each segment."""
        rows = self._read("documents").select("doc_id", F.col("segment").cast("long").alias("segment"), "block", "length")
        last = rows.groupBy("doc_id").agg(F.max("segment").alias("_last"))
        rows = rows.join(last, "doc_id")
        deleted = read_committed(self.spark, f"{self.path}/deletions", "deleted")
        live = F.col("segment") == F.col("_last")
        if deleted is not None:
            until = deleted.groupBy("doc_id").agg(F.max(F.col("batch").cast("long")).alias("_until"))
            rows, live = rows.join(until, "doc_id", "left"), live & (F.coalesce("_until", F.lit(-1)) < F.col("segment"))
        return rows.select("doc_id", "segment", "block", "length", live.alias("live"))

    def merge(self, segments: list[int], into: int) -> bool:
        """Writes what is live in the segments as segment ``into``, which is larger than they are, without reading any
        text, and retires them, in one commit. Segments between them and ``into`` mustn't be there."""
        small_batches(self.spark)
        keys, at = F.col("segment").isin(segments), ["segment", "block"]
        live = self.documents().where(keys & F.col("live"))
        place = [*at, "length", "doc_id"]  # keeps what stood together
        placed = live.repartitionByRange(*place).sortWithinPartitions(*place)
        blocks = staged(placed.select("doc_id", "length", *at, F.floor(F.monotonically_increasing_id() / BLOCK).alias("new")), "blocks")
        moved = blocks.groupBy(*at).agg(F.collect_list(F.struct("doc_id", "new", "length")).alias("m"))  # BLOCK at most
        none = F.lit(None).cast("array<int>")
        heads = moved.select(*at, F.lit(None).cast("string").alias("words"), none.alias("counts"), F.col("m.doc_id").alias("ids"), none.alias("places"), none.alias("tfs"), F.col("m.new").alias("news"), F.col("m.length").alias("lengths"))
        old = self._read("postings").where(keys).select(F.col("segment").cast("long").alias("segment"), "block", "token", "ids", "tfs").mapInArrow(_packed, PACKED)
        rows = heads.unionByName(old).repartitionByRange(*at).sortWithinPartitions(*at, F.col("words").isNotNull())
        retired = self.spark.createDataFrame([(int(s),) for s in segments], "retired long")
        return self._commit(rows.mapInArrow(_moved_postings, ROW), blocks.select("doc_id", "length", F.col("new").alias("block")), into, retired)

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """Results (query_id, doc_id, score, rank) of queries (query_id, text), and of each query the blocks that hold a
        word of it and how many of them were scored (query_id, blocks, scored)."""
        small_batches(self.spark)
        words = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.coalesce("text", F.lit(""))))).alias("token"))
        words = staged(words.groupBy("token").agg(F.collect_set("query_id").alias("queries")), "words")
        documents, at = self.documents(), ["segment", "block"]
        sizes = documents.where("live and length > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"))
        dead = staged(documents.where("not live").groupBy(*at).agg(F.collect_set("doc_id").alias("dead")), "dead")  # BLOCK at most
        rows = self._read("postings").withColumn("segment", F.col("segment").cast("long")).join(words.select("token"), "token", "left_semi").join(dead, at, "left")
        zipped = F.arrays_zip("ids", "tfs", "lengths")
        alive = F.when(F.col("dead").isNull(), zipped).otherwise(F.filter(zipped, lambda p: ~F.array_contains("dead", p["ids"])))
        asked = staged(rows.withColumn("p", alive).where("size(p) > 0").select("token", *at, "p", "most", "least"), "asked-postings")
        frequency = asked.groupBy("token").agg(F.sum(F.size("p")).alias("df"))
        weights = frequency.crossJoin(F.broadcast(sizes)).select("token", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")  # one row of sizes
        weights = staged(weights.join(words, "token"), "weights")  # so small a table, known as such, is sent to the postings
        bounds = asked.select("token", *at, "most", "least").join(weights, "token").select(F.explode("queries").alias("query_id"), *at, impact(F.col("idf"), F.col("most"), F.col("least"), F.col("mean")).alias("most"))
        reach = staged(bounds.groupBy("query_id", *at).agg(F.sum("most").alias("bound")), "block-bounds")
        place = F.expr("row_number() over (partition by query_id order by bound desc, segment, block)")
        chosen = staged(reach.withColumn("_place", place).where(F.col("_place") <= first * k).select("query_id", *at), "first-blocks")
        parts = asked.join(weights, "token").select(*at, "queries", "idf", "mean", F.col("p.ids").alias("ids"), F.col("p.tfs").alias("tfs"), F.col("p.lengths").alias("lengths"))
        early = staged(self._scored(chosen, parts, at), "early-scores")
        bar = staged(ranked(early, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar")), "bars")
        rest = reach.join(bar, "query_id", "left").where("bar is null or bound >= bar").select("query_id", *at).join(chosen, ["query_id", *at], "left_anti")
        rest = staged(rest, "other-blocks")
        late = self._scored(rest, parts, at).join(bar, "query_id", "left").where("bar is null or score >= bar").drop("bar")
        results = ranked(early.unionByName(late), k)
        more = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
        total = reach.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"))
        report = total.join(more, "query_id", "left").select("query_id", "blocks", (F.least(F.col("blocks"), F.lit(first * k)) + F.coalesce("more", F.lit(0))).cast("long").alias("scored"))
        return results, report

    def _scored(self, chosen: DataFrame, parts: DataFrame, at: list[str]) -> DataFrame:
        """query_id, doc_id, score of all documents of the chosen blocks that hold a word of the query. All postings of a
        block meet in one task, which adds scores up, so hits aren't shuffled."""
        wanted = chosen.groupBy(*at).agg(F.collect_set("query_id").alias("_wanted"))  # a block's queries
        rows = parts.join(wanted, at).withColumn("queries", F.array_intersect("queries", "_wanted")).where("size(queries) > 0").drop("_wanted")
        kind = chosen.schema["query_id"].dataType.simpleString()
        return rows.groupBy(*at).applyInArrow(_block_scores, f"query_id {kind}, doc_id long, score long")


def indexed(spark: SparkSession, batches: list[DataFrame], order: str | None = None) -> TextIndex:
    """A new index of the batches, a segment each."""
    return reduce(lambda index, pair: (index.add(pair[1], pair[0], order), index)[1], enumerate(batches, 1), TextIndex(spark))
