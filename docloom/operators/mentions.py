"""Mentions of entities in text: aliases found in one pass over the texts, and merges of entities that can be undone.

Aliases and texts are compared as sequences of search tokens. A filter of bounded size, over hashes of the aliases and of
their first 2, 4, 8, ... tokens, goes to the tasks and keeps the places where an alias may begin; whether one does is
decided by a join on its text. Of matches only the maximal ones count: none that lies within a longer one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import search_tokens
from docloom.llm._bloom import among, filled
from docloom.llm._bytes import POWERS, row_blocks, spans_hash, text_buffers, word_hashes
from docloom.operators.governance import host_of, registered_domain
from docloom.sources.stage import small_batches, staged

#: Aliases that the filter is made for at most: 16 MB, which go to the driver and to each task. With more of them more
#: places pass it and cost a shuffle, never a result.
ALIASES = 1_000_000
#: Bits of the filter for each alias, which has about five keys with ten tokens.
FILTER_BITS = 128
#: Tokens and places looked at together.
TOKENS = 1 << 16
BLANK = 32
#: Tells an alias's hash from that of the first tokens of a longer one.
WHOLE = np.uint64(0xD1B54A32D192ED03)
PLACES = "doc_id long, alias string, tokens int, apart array<int>, meeting array<int>"


def tokens_of(text: F.Column) -> F.Column:
    return F.array_join(search_tokens(F.coalesce(text, F.lit(""))), " ")


def page_aliases(pages: DataFrame) -> DataFrame:
    """alias, entity of pages (url, html): a page's title and host name its address; a link's text names its target,
    a path being one of the page's registered domain. Of an alias with several entities, the one named most often counts,
    then the first by name."""
    html = F.coalesce("html", F.lit(""))
    domain = registered_domain(host_of(F.col("url")))
    link = '<a href="([^"?#]+)">([^<]+)</a>'
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("to"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("text"))
    each = pages.select(domain.alias("domain"), F.explode(links).alias("l")).where("domain <> ''")
    outside = registered_domain(host_of(F.col("l.to")))
    named = each.select(tokens_of(F.col("l.text")).alias("alias"), F.when(F.col("l.to").startswith("/"), F.concat("domain", "l.to")).when(outside != "", outside).alias("entity"))
    address = F.regexp_extract("url", "^[a-zA-Z]+://([^?#]+)", 1)
    titles = pages.select(tokens_of(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("alias"), address.alias("entity"))
    hosts = pages.select(tokens_of(host_of(F.col("url"))).alias("alias"), domain.alias("entity"))
    counts = named.unionByName(titles).unionByName(hosts).where("alias <> '' and entity <> ''").groupBy("alias", "entity").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("alias").agg(F.min(F.struct((-F.col("n")).alias("n"), "entity")).alias("m")).select("alias", "m.entity")


def matches(docs: DataFrame, aliases: DataFrame, most: int = ALIASES) -> DataFrame:
    """doc_id, first, last, alias: the maximal matches of aliases (alias: tokens joined by blanks) in documents (doc_id,
    text), by the numbers of their first and last token. Null and empty texts have none; documents are told apart by doc_id."""
    names = _names(aliases)
    found = _places(docs, names, most).join(names, "alias", "left_semi").repartition("doc_id")
    return _maximal(found.withColumn("first", F.explode(F.concat("apart", "meeting")))).select("doc_id", "first", "last", "alias")


def _names(aliases: DataFrame) -> DataFrame:
    return staged(aliases.select("alias").where("alias <> ''").distinct(), "aliases")


def _maximal(found: DataFrame) -> DataFrame:
    """Of matches (doc_id, first, tokens) those that lie in no longer one, and those without a place."""
    reach = F.expr("max(last) over (partition by doc_id order by first, last desc rows between unbounded preceding and 1 preceding)")
    ends = found.withColumn("last", F.col("first") + F.col("tokens") - 1).withColumn("_reach", reach)
    return ends.where("first is null or _reach is null or last > _reach").drop("_reach")


def _places(docs: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """PLACES rows: the first tokens of what may be one of the names in documents, apart from all others in the text or
    meeting others. All of the names are among them."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = names.groupBy(F.size(F.split("alias", " ")).alias("tokens")).count().toArrow().to_pydict()
    bits = max(6, (FILTER_BITS * min(most, sum(sizes["count"]))).bit_length())
    words = spark.sparkContext.broadcast(filled(names.mapInArrow(_keys, "hash long"), bits))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens_of(F.col("text")).alias("text")).where("text <> ''")
    return texts.mapInArrow(_finder(words, bits, sorted(sizes["tokens"])), PLACES)


def _sums(hashes: np.ndarray) -> np.ndarray:
    POWERS.reach(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * POWERS.up[: len(hashes)], out=sums[1:])
    return sums


def _grams(sums: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Hashes of the n tokens from each place."""
    return spans_hash(sums, at, at + n)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each alias the hashes of its first 2, 4, 8, ... tokens, and of the whole."""
    for b in batches:
        data, offsets = text_buffers(b.column(0))
        for lo, hi in row_blocks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            hashes, _, _, first = word_hashes(part, offsets[lo : hi + 1] - offsets[lo], part == BLANK)
            sums, n = _sums(hashes), np.diff(first)
            keys, step = [_grams(sums, first[:-1], n) ^ WHOLE], 2
            while (n >= step).any():
                keys.append(_grams(sums, first[:-1][n >= step], step))
                step *= 2
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)).view(np.int64))], names=["hash"])


def _finder(held, bits: int, sizes: list[int]):
    def places_of(sums: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First tokens and numbers of tokens of what may be an alias, where each place has some room to its text's end."""
        at, step = np.arange(len(room)), 1
        while True:
            for n in sizes[bisect_left(sizes, step) : bisect_left(sizes, 2 * step)]:
                some = at[room[at] >= n]
                some = some[among(held.value, _grams(sums, some, n) ^ WHOLE, bits)]
                yield some, np.full(len(some), n)
            step *= 2
            if step > sizes[-1]:
                return
            at = at[room[at] >= step]
            at = at[among(held.value, _grams(sums, at, step), bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if sizes else ():
            data, offsets = text_buffers(b.column(1))
            for lo, hi in row_blocks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                hashes, start, end, first = word_hashes(part, offsets[lo : hi + 1] - offsets[lo], part == BLANK)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                found = []
                for begin in range(0, len(hashes), TOKENS):
                    sums = _sums(hashes[begin : begin + TOKENS + sizes[-1]])
                    room = first[row[begin : begin + TOKENS] + 1] - np.arange(begin, min(begin + TOKENS, len(hashes)))
                    found += [(at + begin, n) for at, n in places_of(sums, room)]
                at, n = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, n = at[order], n[order]
                meets = at < np.concatenate([[0], np.maximum.accumulate(at + n)])[:-1]  # one that begins before
                meets[:-1] |= at[1:] < at[:-1] + n[:-1]  # one that begins later
                for i in range(0, len(at), TOKENS):
                    a, k = at[i : i + TOKENS], n[i : i + TOKENS]
                    yield _rows(b.column(0), lo + row[a], a - first[row[a]], k, _cut(part, start[a], end[a + k - 1]), meets[i : i + TOKENS])

    return run


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _rows(docs: pa.Array, row: np.ndarray, first: np.ndarray, tokens: np.ndarray, alias: pa.Array, meets: np.ndarray) -> pa.RecordBatch:
    """A row for each document and alias."""
    alias = alias.dictionary_encode()
    code = alias.indices.to_numpy().astype(np.int64)
    key = row * len(alias.dictionary) + code
    order = np.argsort(key, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order))
    one = order[bounds[:-1]]

    def lists(which: np.ndarray) -> pa.Array:
        sizes = np.concatenate([[0], np.cumsum(which)])
        return pa.ListArray.from_arrays(sizes[bounds].astype(np.int32), pa.array(first[order][which], pa.int32()))

    texts = alias.dictionary.take(pa.array(code[one])).cast(pa.string())
    return pa.RecordBatch.from_arrays([docs.take(pa.array(row[one])), texts, pa.array(tokens[one], pa.int32()), lists(~meets[order]), lists(meets[order])], names=["doc_id", "alias", "tokens", "apart", "meeting"])


def text_mentions(docs: DataFrame, aliases: DataFrame, most: int = ALIASES) -> DataFrame:
    """doc_id, alias, entity, mentions: how often a document mentions each entity by each alias."""
    aliases = staged(aliases.select("alias", "entity"), "aliases")
    names = _names(aliases)
    places = _places(docs, names, most).select("doc_id", "alias", "tokens", F.size("apart").alias("_apart"), "meeting")
    found = places.join(names, "alias", "left_semi").repartition("doc_id")
    # those apart from others are only counted, in a row without a place
    each = found.withColumn("first", F.explode(F.concat(F.array(F.lit(None).cast("int")), "meeting")))
    mentions = F.sum(F.when(F.col("first").isNull(), F.col("_apart")).otherwise(1))
    counts = _maximal(each).groupBy("doc_id", "alias").agg(mentions.alias("mentions")).where("mentions > 0")
    return counts.join(aliases, "alias").select("doc_id", "alias", "entity", "mentions")


def shared_entities(candidates: DataFrame, asked: DataFrame, mentioned: DataFrame) -> DataFrame:
    """query_id, doc_id, rank of candidates (query_id, doc_id) by how many entities the query and the document both
    mention, most first, then doc_id; candidates that share none have no rank."""
    of_query = asked.select(F.col("doc_id").alias("query_id"), "entity").distinct()
    of_doc = mentioned.select("doc_id", "entity").distinct()
    both = candidates.select("query_id", "doc_id").distinct().join(of_query, "query_id").join(of_doc, ["doc_id", "entity"])
    shared = both.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    order = F.expr("row_number() over (partition by query_id order by shared desc, doc_id)")
    return shared.select("query_id", "doc_id", order.cast("long").alias("rank"))


def live_merges(merges: DataFrame, version: int | None = None) -> DataFrame:
    """entity, into: the merges (version, entity, into, undone) that hold as of a version (None: the last). A row with
    ``undone`` takes back the one edge that it names and no other; merging an entity anew replaces its edge."""
    seen = merges if version is None else merges.where(F.col("version") <= version)
    last = seen.groupBy("entity", "into").agg(F.max_by("undone", "version").alias("undone"), F.max("version").alias("version"))
    edges = last.where("not undone and entity <> into")
    return edges.groupBy("entity").agg(F.max_by("into", F.struct("version", "into")).alias("into"))


def resolved(merges: DataFrame, version: int | None = None) -> DataFrame:
    """entity, merged: where each merged entity's chain of merges ends as of a version. Entities that were merged in a
    circle all end at the first of them by name. Pointers are doubled, so a chain of n merges takes log n joins."""
    spark = merges.sparkSession
    edges = staged(live_merges(merges, version), "merges")
    hops = edges.select("entity", F.col("into").alias("at"), F.least("entity", "into").alias("least"))
    n = edges.count()
    length = 1
    while length <= n:  # after 2**i steps a chain has ended or goes round
        step = hops.select(F.col("entity").alias("at"), F.col("at").alias("_next"), F.col("least").alias("_least"))
        after = hops.join(step, "at", "left").select("entity", F.coalesce("_next", "at").alias("at"), F.least("least", F.coalesce("_least", "least")).alias("least"))
        hops, length = staged(after, "merges"), length * 2
    round_ = hops.join(edges.select(F.col("entity").alias("at")), "at", "left_semi")  # still on the way: in a circle
    circle = round_.join(hops.select(F.col("entity").alias("at"), F.col("least").alias("_of")), "at").select("entity", F.col("_of").alias("merged"))
    ended = hops.join(edges.select(F.col("entity").alias("at")), "at", "left_anti").select("entity", F.col("at").alias("merged"))
    return ended.unionByName(circle)


def merged_entities(entities: DataFrame, merges: DataFrame, version: int | None = None) -> DataFrame:
    """``entities`` (with a column entity) with merged: the entity that theirs is now. Aliases and entities stay, so that
    every version can be seen again and any merge undone."""
    into = resolved(merges, version).select("entity", F.col("merged").alias("_merged"))
    return entities.join(into, "entity", "left").withColumn("merged", F.coalesce("_merged", "entity")).drop("_merged")
