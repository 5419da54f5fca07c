"""Near duplicates by banded MinHash candidates and sequential Bayesian verification.

Documents with equal sets are one class; classes are compared, copies are not. A class has HASHES minima of its set under
unlike hash functions, of which 16 bits each are kept. BANDS bands of ROWS minima are hashed; classes that share a band's
hash are candidates. Sets of similarity s share none with probability (1 - s**ROWS)**BANDS: 6e-9 at 0.85.

A candidate pair's signatures are compared in batches of BATCH minima. After each batch the posterior of the similarity,
from a uniform prior and the agreements so far, tells how probable the least similarity is still; a pair goes where that
is under ``miss``. What is left after all minima is verified on whole sets, so no pair is linked by estimate. First by
the parities of their shingles in buckets, four or more to a shingle: two sets differ in at least as many shingles as
parities, so pairs that differ in too many are rejected exactly, without their texts. Then by the texts.

Bands' lists are cut by their counts: one of over ``tile`` classes is dealt to tasks in stretches. Neighbours in a list
are tested first. What is then in different components is compared inside the task that holds the list, or two stretches
of it; only pairs that survive become rows, each in the first list that both are in: at first the best partner of each
class, then, of components that are still apart, all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _bytes as B
from docloom.llm._bloom import may_be_in
from docloom.llm._shared import free_name, frugal, gathered, remove, ship_package, small_batches, staged
from docloom.llm.components import connected_components
from docloom.llm.jaccard_join import CHECK_BITS, SEEN, TILE, Rule, by_component, class_of, confirmed, in_bands, labelled, text_sets, tiles, whole_texts

#: Similarity is share_num / share_den on sets of word shingles.
WORDS, SHARE_NUM, SHARE_DEN = 3, 85, 100
BANDS, ROWS = 40, 6
HASHES, BATCH = BANDS * ROWS, 24
#: The probability below which a pair that may be similar is given up after a batch.
MISS = 1e-9
#: Neighbours in a list that are tested first.
NEIGHBOURS = 2
#: Buckets of a shingle, and the most buckets of a set; more shingles share them.
BUCKETS, MOST_BUCKETS = 4, 1 << 20
#: Shingles and classes that are looked at together.
BLOCK, PAIRS = 512, 4_000

_random = np.random.default_rng(13)
XORS, ODDS = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint32) for _ in range(2))
ODDS |= np.uint32(1)
BAND_SALTS = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each of a set's minima."""
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), BLOCK):
        h = (x[None, i : i + BLOCK] ^ XORS[:, None]) * ODDS[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """The bands' hashes of each row; the last six bits are the band's number."""
    values = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = B.mix((values * BAND_SALTS).sum(axis=2, dtype=np.uint64)) & ~np.uint64(63)
    return (h | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def parity(s: np.ndarray) -> bytes:
    """Of each bucket, whether an odd number of a set's shingles fall into it: a power of two of bits."""
    buckets = min(1 << max(6, (BUCKETS * len(s) - 1).bit_length()), MOST_BUCKETS)
    counts = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(parities: np.ndarray, size: int) -> np.ndarray:
    """Parities in fewer buckets, ``size`` bytes a row."""
    while parities.shape[1] > size:
        half = parities.shape[1] // 2
        parities = parities[:, :half] ^ parities[:, half:]
    return parities


def may_link(rule: Rule, na, nb, parity_a: np.ndarray, parity_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar, by rows of parities."""
    size = min(parity_a.shape[1], parity_b.shape[1])
    differ = np.bitwise_count(folded(parity_a, size) ^ folded(parity_b, size)).sum(axis=1, dtype=np.int64)
    return (rule.den + rule.num) * differ <= (rule.den - rule.num) * (na + nb)


def signatures_of(column: pa.Array) -> np.ndarray:
    data, _ = B.text_buffers(column)
    return np.ascontiguousarray(data).view(np.uint16).reshape(-1, HASHES)


@cache
def least_agreements(n: int, num: int, den: int, miss: float) -> int:
    """The fewest of n agreements at which a similarity of num / den or more isn't less probable than ``miss``.

    With a uniform prior the posterior after m agreements is Beta(m + 1, n - m + 1), and the probability of at least t
    is that of at most m successes in n + 1 trials of probability t."""
    t, total = num / den, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, rule: Rule, miss: float) -> np.ndarray:
    """Places of the rows of a and b (signatures) that no batch gives up."""
    left, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i in range(0, HASHES, BATCH):
        agree = agree + (a[left, i : i + BATCH] == b[left, i : i + BATCH]).sum(axis=1)
        stay = agree >= least_agreements(min(i + BATCH, HASHES), rule.num, rule.den, miss)
        left, agree = left[stay], agree[stay]
    return left


MEMBER, CLASS = range(2)
SIGNED = "kind int, doc_id long, row_hash long, class long, size long, signature binary, parity binary"


def signed_rows(words: int):
    """Each document's class, and once for each class and task a document of it with signature and parities."""
    names = [f.split()[0] for f in SIGNED.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            out = []
            for doc, row, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_sets(b.column(2), words), strict=True):
                key, size = class_of(s) if len(s) else (0, 0)
                out.append((MEMBER, doc, row, key, size, None, None))
                if size and (key, size) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((key, size))
                    out.append((CLASS, doc, row, key, size, signature(s).tobytes(), parity(s)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return run


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (x, id, n) for each band of the classes (id, n, signature)."""
    for b in gathered(batches, PAIRS):
        x = band_hashes(signatures_of(b.column(2)))
        each = [np.repeat(b.column(i).to_numpy(zero_copy_only=False), BANDS) for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1)), *map(pa.array, each)], names=["x", "id", "n"])


def band_lists(classes: DataFrame, rule: Rule, tile: int) -> tuple[DataFrame, list[str]]:
    """Rows (x, c, id, n, band, up, down) of all bands' lists of two classes at least, and the paths behind them.

    Counts are taken first; most bands are of one class alone, and a Bloom filter of the others keeps those from being
    shuffled."""
    rows = classes.select("id", "n", "signature").mapInArrow(frugal(band_rows), "x long, id long, n long")
    shared, shared_path = staged(rows.groupBy("x").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("x"), "shared-bands")
    maybe = rows.where(may_be_in(shared)(F.col("x"))).join(shared, "x", "left_semi")
    listed, path = staged(maybe.select("x", F.lit(0).alias("c"), "id", "n"), "band-rows")
    out, out_path = staged(in_bands(listed, rule, tile), "band-lists")
    remove(classes.sparkSession, shared_path, path)
    return out, [out_path]


def neighbours(listed: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of classes next to one another in a list, or in a stretch of a long one, that sizes allow."""
    stretch = F.when(F.col("up") == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.greatest("up", F.lit(1))))
    size_band = F.when(F.col("up") == 0, F.lit(-1)).otherwise(F.col("band"))
    rows = listed.select("x", size_band.alias("band"), stretch.alias("s"), "id", "n")
    order = "over (partition by x, band, s order by n, id)"
    before = rows.selectExpr("id", "n", *(f"lag(struct(id, n), {d}) {order} as l{d}" for d in range(1, NEIGHBOURS + 1)))
    each = before.select("id", "n", F.explode(F.array(*(f"l{d}" for d in range(1, NEIGHBOURS + 1)))).alias("l")).where("l is not null")
    near = each.where(f"{rule.den} * l.n >= {rule.num} * n")
    return near.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()


def tested(pairs: DataFrame, classes: DataFrame, rule: Rule, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures and parities survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, PAIRS):
            left = surviving(signatures_of(b.column(2)), signatures_of(b.column(3)), rule, miss)
            b = b.take(pa.array(left))
            row = lambda i, k: np.frombuffer(b.column(i)[k].as_py(), np.uint8)[None]
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
            keep = [bool(may_link(rule, na[k], nb[k], row(4, k), row(5, k))[0]) for k in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda p: classes.select(F.col("id").alias(p), F.col("signature").alias(f"s{p}"), F.col("parity").alias(f"p{p}"), F.col("n").alias(f"n{p}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb", "pa", "pb", "na", "nb").mapInArrow(frugal(run), "a long, b long")


TILED = ["x", "band", "i", "j", "own", "later", "id", "component", "n", "signature", "parity"]


def compare_lists(rule: Rule, miss: float, best: bool):
    """Of rows (TILED) sorted by x, band, i, j: pairs (a, b) of different components that sizes allow and that survive,
    each in the list of the first band that both share. ``best``: of each class only one, with the most agreements."""

    def compare(x: int, rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        own, later, key, component, n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        values = signatures_of(pa.array([r[5] for r in rows], pa.binary()))
        lengths, place, parities = np.array([len(r[6]) for r in rows]), np.zeros(len(rows), np.int64), {}
        for size in np.unique(lengths):
            of_size = np.flatnonzero(lengths == size)
            place[of_size] = np.arange(len(of_size))
            parities[size] = np.frombuffer(b"".join(rows[k][6] for k in of_size), np.uint8).reshape(-1, size)
        bands, here = values.reshape(-1, BANDS, ROWS), x & 63
        i, j = own.min(), own.max()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for p in left:
            q = right[(component[right] != component[p]) & (rule.den * np.minimum(n[right], n[p]) >= rule.num * np.maximum(n[right], n[p])) & (later[right] + later[p] < 2)]
            q = q[q > p] if i == j else q
            q = q[surviving(np.broadcast_to(values[p], (len(q), HASHES)), values[q], rule, miss)]
            q = q[(bands[q] == bands[p]).all(axis=2).argmax(axis=1) == here] if len(q) else q
            mine = parities[lengths[p]][place[p]][None]
            same = [q[lengths[q] == size] for size in np.unique(lengths[q])]
            same = [g[may_link(rule, n[p], n[g], mine, parities[lengths[g[0]]][place[g]])] for g in same]
            q = np.concatenate(same) if same else q
            if best and len(q):
                q = q[[(values[q] == values[p]).sum(axis=1).argmax()]]
            out.append((np.minimum(key[q], key[p]), np.maximum(key[q], key[p])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            found = []
            for x, band, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(len(TILED))), strict=True):
                if (x, band, i, j) != at:
                    found += compare(at[0], rows) if len(rows) > 1 else []
                    at, rows = (x, band, i, j), []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(2)], names=["a", "b"])
        for a, b in compare(at[0], rows) if len(rows) > 1 else []:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = SHARE_NUM, den: int = SHARE_DEN, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, row_hash (xxhash64 of the text), n_shingles, class, component_id, leads.

    component_id is the smallest doc_id reachable by links; leads marks the one (doc_id, row_hash) that stands for its
    component. Null or blank text has an empty set and no class, is linked with nothing and stands for itself. Rows that
    repeat id and text are alike in every column. Null ids are passed over for component_id, which is null if there is
    no other. Other columns of ``docs``, whatever their names, aren't looked at; an empty table gives an empty result.
    Very long texts are read in blocks of words, whole. A link is always confirmed on whole sets; one may be missed with
    the probabilities given above."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    rule = Rule(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col))
    signed, signed_path = staged(rows.mapInArrow(frugal(signed_rows(words)), SIGNED), "minhashes")
    one = signed.where(F.col("kind") == CLASS).groupBy("class", "size").agg(F.min(F.struct("doc_id", "row_hash", "signature", "parity")).alias("r"))
    classes, classes_path = staged(one.select("class", "size", F.expr(f"size >> {CHECK_BITS}").alias("n"), F.monotonically_increasing_id().alias("id"), "r.*"), "classes")
    members, members_path = staged(signed.where(F.col("kind") == MEMBER).select("doc_id", "row_hash", "class", "size"), "members")
    remove(spark, signed_path)
    whole = whole_texts(docs, id_col, text_col)
    listed, list_paths = band_lists(classes, rule, tile)
    pairs, pairs_path = staged(tested(neighbours(listed, rule), classes, rule, miss), "pairs")
    links, links_path = confirmed(pairs, classes, whole, rule, words)
    components, components_path = connected_components(links)
    remove(spark, links_path)
    done, done_paths = pairs, [pairs_path]
    for best in (True, False):
        mixed, mixed_path = staged(labelled(listed, components), "mixed-lists")
        near = tiles(mixed).join(classes.select("id", "signature", "parity"), "id").select(*TILED)
        near = near.repartition("x", "band", "i", "j").sortWithinPartitions("x", "band", "i", "j")
        found = near.mapInArrow(frugal(compare_lists(rule, miss, best)), "a long, b long").distinct().join(done, ["a", "b"], "left_anti")
        more, more_path = staged(found, "pairs")
        remove(spark, mixed_path)
        done, done_paths = done.unionByName(more), [*done_paths, more_path]
        if more.isEmpty():
            continue
        links, links_path = confirmed(more, classes, whole, rule, words)
        edges = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
        after, after_path = connected_components(edges)
        remove(spark, links_path, components_path)
        components, components_path = after, after_path
    remove(spark, *done_paths, *list_paths)
    return by_component(members, classes, components, classes_path, components_path)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns. Rows that repeat id and text stay or
    go together; null and blank texts stay; an empty table stays empty."""
    gone, _ = staged(near_duplicates(docs, id_col, text_col, **parameters).where("not leads").select("doc_id", "row_hash").distinct(), "gone")
    gone_id, gone_hash = free_name(docs, "gone_id", "gone_hash")
    named = gone.select(F.col("doc_id").alias(gone_id), F.col("row_hash").alias(gone_hash))
    same = (F.xxhash64(F.col(text_col)) == F.col(gone_hash)) & F.col(id_col).cast("long").eqNullSafe(F.col(gone_id))
    return docs.join(named, same, "left_anti")
