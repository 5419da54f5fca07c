"""Retrieval: postings, BM25, exact vector search, rank fusion with duplicate suppression, search inside a scope.

Scores are summed as whole millionths, so the order of a sum never shows; equal scores go by id."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import search_tokens
from docloom.sources.stage import small_batches, staged

K1, B = 1.2, 0.75
RRF = 60
#: Queries and vectors in a block, and blocks of queries for which a task holds its best results.
QUERY_BLOCK, VECTOR_BLOCK, HELD = 512, 4096, 64
#: Words of queries that go to tasks at once, and cells of a table of queries by documents that a task fills at once.
ASKED, HIT_CELLS = 500_000, 1 << 20
#: Of pairs that don't count.
LEAST = -(10**9)


def postings(docs: DataFrame, scope: str | None = None) -> DataFrame:
    """(scope,) token, doc_id, tf, length (of the document, in tokens); documents without a token have no row."""
    keys = ["doc_id", *([scope] if scope else [])]
    tokens = docs.select(*keys, search_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    each = tokens.select(*keys, F.size("tokens").cast("long").alias("length"), F.explode("tokens").alias("token"))
    return each.groupBy(*keys, "token", "length").agg(F.count(F.lit(1)).alias("tf"))


def token_frequencies(docs: DataFrame) -> DataFrame:
    """token, df (documents), cf (occurrences)."""
    return postings(docs).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each query by score, then doc_id, with their rank. Tasks keep k rows of a query before they meet."""
    order = F.expr("row_number() over (partition by query_id order by score desc, doc_id)")
    return scored.withColumn("rank", order).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def filtered(docs: DataFrame, allowed: Mapping[str, Sequence] | None = None, ranges: Mapping[str, tuple] | None = None) -> DataFrame:
    """The documents that a search may see: columns with one of the allowed values, and columns in a range (either end
    None: open). Nulls are in no set and no range. Filters come before ranking, so counts and ranks tell nothing of the rest."""
    for column, values in (allowed or {}).items():
        docs = docs.where(F.col(column).isin(list(values)))
    for column, (low, high) in (ranges or {}).items():
        docs = docs.where(F.col(column) >= low) if low is not None else docs
        docs = docs.where(F.col(column) <= high) if high is not None else docs
    return docs


class Asked:
    """A block of queries as tasks need it: ids of tokens, and for each scope its statistics and the queries of a token."""

    def __init__(self, rows: list, tokens: pa.Array) -> None:
        self.tokens, place = tokens, {t: i for i, t in enumerate(tokens.to_pylist())}
        self.queries = np.unique(np.array([r.query_id for r in rows], np.int64))
        by_scope: dict = {}
        for r in rows:
            by_scope.setdefault(r["scope"], []).append(r)
        self.scopes = {}
        for scope, mine in by_scope.items():
            token, query = np.array([place[r.token] for r in mine]), np.searchsorted(self.queries, [r.query_id for r in mine])
            order = np.argsort(token, kind="stable")
            idf = np.zeros(len(tokens))
            idf[token] = [r.idf for r in mine]
            self.scopes[scope] = idf, mine[0]["mean"], np.searchsorted(token[order], np.arange(len(tokens) + 1)), query[order]

    def hits(self, scope, ids: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of hits (queries by n rows) of occurrences of tokens in rows."""
        idf, mean, first, queries = self.scopes[scope]
        part = np.floor(idf[ids] * tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * lengths / mean)) * 1e6 + 0.5)
        times = first[ids + 1] - first[ids]
        begin = np.cumsum(times) - times
        each = np.arange(int(times.sum())) - np.repeat(begin - first[ids], times)
        at, size = queries[each] * n + np.repeat(rows, times), len(self.queries) * n
        return np.bincount(at, np.repeat(part, times), size).astype(np.int64).reshape(-1, n), np.bincount(at, minlength=size).reshape(-1, n)


def bm25(docs: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """query_id, doc_id, score (millionths), rank. ``queries``: query_id, text (and the scope column).

    With a scope, only documents of the query's scope are ranked, and counts of documents and lengths are taken inside
    it, so that a rank tells nothing about others' documents. Texts are tokenised once; what is written of a document is
    one row: its length, and the queries' tokens in it with their counts. A second pass scores each row against all
    queries of a block and keeps k rows of a query in a task, so hits never become rows. Queries of more than
    ASKED words go in several blocks, each a pass."""
    on = F.col(scope) if scope else F.lit("")
    words = queries.select("query_id", on.alias("scope"), F.explode(F.array_distinct(search_tokens(F.coalesce("text", F.lit(""))))).alias("token")).where("scope is not null")
    blocks = max(1, -(-words.count() // ASKED))
    found = [_bm25_block(docs, words.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, on) for i in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return ranked(out, k)


def _bm25_block(docs: DataFrame, words: DataFrame, k: int, on: Column) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    tokens = words.select("token").distinct().orderBy("token").toArrow()["token"].combine_chunks()  # ASKED at most
    sent = spark.sparkContext.broadcast(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            place = pc.index_in(b.column(2).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lengths)
            pairs, tf = np.unique((row * (len(known) + 1) + place)[place >= 0], return_counts=True)
            row, place = np.divmod(pairs, len(known) + 1)
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (place, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths.astype(np.int64)), *lists], names=["doc_id", "scope", "length", "ids", "tfs"])

    texts = docs.select("doc_id", on.alias("scope"), search_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).where("scope is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = texts.mapInArrow(count, f"doc_id {kind}, scope string, length long, ids array<int>, tfs array<int>")
    rows = staged(counted.where("length > 0"), "postings")
    sizes = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"))
    frequency = rows.select("scope", F.explode("ids").alias("at")).groupBy("scope", "at").agg(F.count(F.lit(1)).alias("df"))
    names = spark.createDataFrame(pa.table({"at": pa.array(range(len(tokens)), pa.int32()), "token": tokens})) if len(tokens) else spark.createDataFrame([], "at int, token string")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = words.join(names, "token").join(frequency, ["scope", "at"]).join(sizes, "scope").select("query_id", "scope", "token", idf.alias("idf"), "mean").collect()  # a row for each word of the block's queries
    held = spark.sparkContext.broadcast(Asked(asked, tokens))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        n_queries = len(block.queries)
        best, doc = np.zeros((n_queries, 0), np.int64), np.zeros((n_queries, 0), np.int64)
        step = max(1, HIT_CELLS // max(1, n_queries))
        for batch in batches if n_queries else ():
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                n = part.num_rows
                counts = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                ids, tfs = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
                lengths, row = part.column(2).to_numpy(zero_copy_only=False), np.repeat(np.arange(n), counts)
                scores, hits = np.zeros((n_queries, n), np.int64), np.zeros((n_queries, n), np.int64)
                scopes = np.array(part.column(1).to_pylist(), object)
                for scope in set(scopes) & set(block.scopes):
                    mine = (scopes == scope)[row]
                    more = block.hits(scope, ids[mine], tfs[mine], lengths[row[mine]], row[mine], n)
                    scores, hits = scores + more[0], hits + more[1]
                scores[hits == 0] = LEAST
                best = np.concatenate([best, scores], axis=1)
                doc = np.concatenate([doc, np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), scores.shape)], axis=1)
                order = np.lexsort((doc, -best), axis=1)[:, :k]
                best, doc = np.take_along_axis(best, order, 1), np.take_along_axis(doc, order, 1)
        ok = best > LEAST
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.queries, ok.sum(axis=1))), pa.array(doc[ok]), pa.array(best[ok])], names=["query_id", "doc_id", "score"])

    return rows.select("doc_id", "scope", "length", "ids", "tfs").mapInArrow(score, "query_id long, doc_id long, score long")


PACK = "ids binary, vectors binary"


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, doc_id, score (cosine in millionths), rank: the k nearest others of each query, exactly.

    Queries and vectors are packed into blocks of rows, and blocks meet blocks: every vector is compared with every
    query of the set, in one scan of the vectors. Spark sends the blocks of queries to all tasks if its broadcast
    threshold allows, and deals pairs of blocks to tasks if not. A task keeps k of its vectors for each query. Null or
    zero vectors have no cosine and are left out; vectors are of one length."""

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, size):
                    part = b.slice(i, size)
                    m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                    norm = np.linalg.norm(m, axis=1)
                    m, ids = m[norm > 0] / norm[norm > 0, None], part.column(0).to_numpy(zero_copy_only=False)[norm > 0]
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["ids", "vectors"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (best, found) in held.items():
                ids, ok = np.frombuffer(name, np.int64), best > LEAST
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(found[ok]), pa.array(best[ok])], names=["query_id", "doc_id", "score"])
            held.clear()

        for batch in batches:
            for name, asked, docs, values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, doc = np.frombuffer(name, np.int64), np.frombuffer(docs, np.int64)
                q, v = np.frombuffer(asked).reshape(len(ids), -1), np.frombuffer(values).reshape(len(doc), -1)
                cosine = np.round(q @ v.T * 1e6).astype(np.int64)
                cosine[ids[:, None] == doc[None, :]] = LEAST
                doc = np.broadcast_to(doc, cosine.shape)
                if name in held:
                    cosine, doc = (np.concatenate(x, axis=1) for x in zip(held[name], (cosine, doc), strict=True))
                order = np.lexsort((doc, -cosine), axis=1)[:, :k]
                held[name] = np.take_along_axis(cosine, order, 1), np.take_along_axis(doc, order, 1)
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    small_batches(vectors.sparkSession)
    rows = lambda df: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col)
    asked = rows(queries).mapInArrow(pack(QUERY_BLOCK), PACK).select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    pairs = rows(vectors).mapInArrow(pack(VECTOR_BLOCK), PACK).crossJoin(asked)  # blocks with blocks of the stated query set
    return ranked(pairs.select("query_ids", "query_vectors", "ids", "vectors").mapInArrow(score, "query_id long, doc_id long, score long"), k)


def signal_ranks(candidates: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """query_id, doc_id, rank of the candidates (query_id, doc_id) by a value of the documents, largest first, then
    doc_id; documents without a value have no rank."""
    known = candidates.select("query_id", "doc_id").distinct().join(values.select("doc_id", value).where(F.col(value).isNotNull()), "doc_id")
    order = F.expr(f"row_number() over (partition by query_id order by `{value}` desc, doc_id)")
    return known.select("query_id", "doc_id", order.cast("long").alias("rank"))


def search_quality(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, hits, precision and recall (millionths) of the first k results of each query against judgements
    (query_id, doc_id); precision is of k places, recall is null for a query without a relevant document."""
    hits = results.where(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    known = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("known"))
    both = queries.select("query_id").distinct().join(hits, "query_id", "left").join(known, "query_id", "left").fillna(0, ["hits"])
    return both.select("query_id", "hits", F.expr(f"(hits * 1000000) div {k}").alias("precision"), F.when(F.col("known") > 0, F.expr("(hits * 1000000) div known")).alias("recall"))


def holding(docs: DataFrame, items: DataFrame, words: int = 5) -> DataFrame:
    """query_id, doc_id: documents that hold an item's tokens in sequence. Found by the item's first ``words`` tokens
    as a hash key, then looked at whole; items of fewer tokens are left out."""
    keyed = items.select("query_id", search_tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") >= words).select("query_id", F.array_join("t", " ").alias("item"), F.array_join(F.slice("t", 1, words), " ").alias("key"))
    tokens = docs.select("doc_id", search_tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") >= words)
    keys = F.transform(F.sequence(F.lit(1), F.size("t") - words + 1), lambda i: F.array_join(F.slice("t", i, words), " "))
    found = tokens.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).join(keyed.select("query_id", "key"), "key").select("doc_id", "query_id").distinct()
    both = found.join(tokens, "doc_id").join(keyed.select("query_id", "item"), "query_id")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return both.where(F.contains(padded(F.array_join("t", " ")), padded(F.col("item")))).select("query_id", "doc_id")


def fused(docs: DataFrame, k: int, *lists: DataFrame) -> DataFrame:
    """query_id, doc_id, score (millionths), rank: reciprocal rank fusion of ranked lists (text, vectors, or signals such
    as quality and recency); of documents with equal texts, only the best of a query's list stays."""
    both = lists[0].select("query_id", "doc_id", "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select("query_id", "doc_id", "rank"))
    part = F.round(F.lit(1e6) / (RRF + F.col("rank"))).cast("long")
    scored = both.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    first = scored.join(hashed, "doc_id", "left").withColumn("content", F.coalesce("content", F.concat(F.lit("vector "), F.col("doc_id").cast("string"))))
    first = first.withColumn("copy", F.expr("row_number() over (partition by query_id, content order by score desc, doc_id)")).where("copy = 1")
    return ranked(first.select("query_id", "doc_id", "score"), k)
