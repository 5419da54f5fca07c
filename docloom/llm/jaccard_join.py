"""Near duplicates by a size-aware heavy-light join on sets of word shingles.

Documents with equal sets are one class; classes are compared, copies are not.

Light classes (small sets): two sets are similar if and only if they share as many shingles as their sizes demand. Each
light set enumerates its subsets of those sizes, and whoever shares a subset is linked: the smallest set of a subset's
list to every other that the size allows, which links all that belong together.

Heavy classes (large sets): a set and a similar one share a shingle among their first n - ceil(t n) + 1 in any fixed
order. Inverted lists of these shingles are scanned in order of size. Very frequent shingles come last in the order, so
a passage that many documents share hardly enters the lists; which ones they are is counted over all documents (lossy
counting), and only the work, never the result, depends on it. Candidates are verified on whole texts.

A class is named by 80 bits of two unlike hashes of its set and by the set's size, and gets a number of its own once all
classes are known. Texts are fetched for the classes that a test asks for alone: a Bloom filter of their rows keeps all
other texts out of the shuffle.

A list of many classes isn't expanded into rows of pairs, and a list of very many is scanned in stretches. Neighbours in
the list are verified first, then random neighbours of different components. What is then in different components is
compared inside the task that holds the list, or a tile of two stretches of a long one, cut by size: a set's shingles
counted in BUCKETS parts bound every intersection from above by the sum of the smaller counts. Only pairs that this
exact bound allows are verified on their texts, and every one of them is, so no link between components is lost. The
boundary between light and heavy is the largest size at which enumerating costs no more than scanning, at a given ratio
of their costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _bytes as B
from docloom.llm._bloom import may_be_in
from docloom.llm._shared import FILE_ROWS, free_name, frugal, gathered, remove, ship_package, small_batches, staged
from docloom.llm.components import connected_components

#: Similarity is share_num / share_den: sets A and B are linked if share_den * |A and B| >= share_num * |A or B|.
WORDS, SHARE_NUM, SHARE_DEN = 5, 80, 100
#: What verifying and scanning one list entry costs, in enumerated subsets.
COST_RATIO = 16
#: Frequent shingles that go last: at most so many (8 bytes each in every task), and from so many documents on.
FREQUENT, FREQUENT_FROM = 100_000, 16
#: Neighbours in a list that are verified first; a list of no more than BAND + 1 classes is thereby done.
BAND = 4
#: Parts of a set's counts, and classes of a stretch of a list; a tile compares two stretches.
BUCKETS, TILE = 256, 4096
#: Bits of a class's second hash, and of a shingle's hash in the lists, where a collision costs a test and no more.
CHECK_BITS, LIST_BITS = 16, 48
#: Texts of a file, or pairs of texts that a task compares.
TEXT_ROWS = 2_000
#: Lists of a class by which a pair's repetitions are told.
NAMED = 16
#: Shingles that one step of the lossy count looks at, and classes that a task remembers having seen.
STEP, SEEN = 1_000_000, 50_000


class Rule:
    def __init__(self, num: int = SHARE_NUM, den: int = SHARE_DEN) -> None:
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n + (-n * self.num // self.den) + 1

    def overlap(self, a: int, b: int) -> int:
        """The least intersection that links sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-n * self.num // self.den), n * self.den // self.num + 1)

    def overlaps(self, n: int) -> list[int]:
        return sorted({c for b in self.partners(n) if (c := self.overlap(n, b)) <= min(n, b)})

    def light_sizes(self, cost_ratio: float = COST_RATIO) -> int:
        """The largest size up to which enumerating subsets costs no more than scanning lists."""
        n = 1
        while sum(comb(n + 1, c) for c in self.overlaps(n + 1)) <= cost_ratio * self.prefix(n + 1):
            n += 1
        return n


def text_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    data, offsets = B.text_buffers(column)
    for i, j in B.row_blocks(offsets):
        hashes, _, _, first = B.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        grams, begin = B.gram_hashes(hashes, first, words)
        for k in range(j - i):
            yield np.unique(grams[begin[k] : begin[k + 1]])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def class_of(s: np.ndarray) -> tuple[int, int]:
    """A set's class: a hash, and its size above some bits of another hash."""
    return signed(B.hash_of_set(s)), len(s) << CHECK_BITS | B.check_of_set(s, CHECK_BITS)


def frequent_shingles(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingle hashes in order, at most FREQUENT of them, and their counts, counted over all rows; a class counts once for each
    task that sees it, and a shingle seen once in a step of STEP shingles isn't counted for that step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush():
            x, n = np.unique(np.concatenate(held), return_counts=True)
            x, n = x[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], names=["x", "n"])

        for b in batches:
            for s in text_sets(b.column(0), words):
                key = B.hash_of_set(s)
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                held.append(s)
                size += len(s)
                if size >= STEP:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = docs.select(text_col).mapInArrow(frugal(run), "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow()
    x, n = top["x"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def bucket_counts(s: np.ndarray) -> bytes | None:
    """A set's sizes in BUCKETS parts, a byte each; null (no bound) if one doesn't fit."""
    n = np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def counts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' counts, and which rows have any."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    data, _ = B.text_buffers(column.drop_null())
    out = np.zeros((len(column), BUCKETS), np.uint8)
    out[known] = data.reshape(-1, BUCKETS)
    return out, known


def may_link(rule: Rule, na: np.ndarray, nb: np.ndarray, most: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar if their intersection has ``most`` elements at most."""
    return ~known | ((rule.num + rule.den) * most >= rule.num * (na + nb))


MEMBER, CLASS, PREFIX, SUBSET = range(4)
SIGNATURES = "kind int, doc_id long, row_hash long, class long, size long, x long, c int, counts binary"


def signatures(rule: Rule, words: int, light: int, frequent, tile: int) -> object:
    """Rows (kind, doc_id, row_hash, class, size, x, c, counts): each document's class; once for each class and task a
    document of it with its set's counts, and its prefix shingles x, c being 0 or from 1 on a stretch of a frequent
    shingle's list, or its subsets' hashes x of size c."""
    both = rule.partners(light + 1)[0] if rule.partners(light + 1) else light + 1
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in SIGNATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, often), seen = frequent.value, set()
        stretches = np.where(often > tile, -(-often // tile), 0)
        for b in batches:
            out: list[tuple] = []
            xs: list[np.ndarray] = []
            shape: list[tuple[int, int, int, int]] = []  # kind, class, size, entries
            cs: list[np.ndarray] = []
            for doc, row, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_sets(b.column(2), words), strict=True):
                n = len(s)
                key, size = class_of(s) if n else (0, 0)
                out.append((MEMBER, doc, row, key, size, None, None, None))
                if not n or (key, size) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((key, size))
                out.append((CLASS, doc, row, key, size, None, None, bucket_counts(s)))
                if n <= light:
                    for c in rule.overlaps(n):
                        subsets = np.array(list(combinations(s, c)), np.uint64)
                        xs.append(B.mix(B.mix(subsets + np.uint64(c)).sum(axis=1, dtype=np.uint64)))
                        cs.append(np.full(len(subsets), c, np.int32))
                        shape.append((SUBSET, key, size, len(subsets)))
                if n >= both:
                    stretch = np.zeros(n, np.int32)
                    if len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        late = last[at] == s
                        parts = stretches[at] * late
                        stretch[parts > 0] = 1 + abs(key) % parts[parts > 0]
                        s, stretch = np.concatenate([s[~late], s[late]]), np.concatenate([stretch[~late], stretch[late]])
                    p = rule.prefix(n)
                    xs.append(s[:p] & np.uint64((1 << LIST_BITS) - 1))
                    cs.append(stretch[:p])
                    shape.append((PREFIX, key, size, p))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)
            times = np.array([e[3] for e in shape], np.int64)
            col = lambda i, t: pa.array(np.repeat(np.array([e[i] for e in shape], t), times))
            if k := int(times.sum()):
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([col(0, np.int32), none, none, col(1, np.int64), col(2, np.int64), pa.array(np.concatenate(xs).view(np.int64)), pa.array(np.concatenate(cs)), pa.nulls(k, pa.binary())], names=names)

    return run


class Runs:
    """A sorted stream of (x, c, size, class) cut into lists of equal x and c, without repeated rows; only ``keep`` rows are held."""

    def __init__(self, keep: int) -> None:
        self.keep, self.rows, self.at = keep, np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def extend(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """All held and new rows, each one's place in its list, and how many of them were held before."""
        rows = np.stack(columns, axis=1)
        old = len(self.rows)
        rows = np.concatenate([self.rows, rows])
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        new[:old] = True
        rows = rows[new]
        starts = np.ones(len(rows), bool)
        starts[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(rows)), 0))
        place = np.arange(len(rows)) - begin
        if old:
            place += np.where(begin == 0, self.at[0], 0)
        self.rows, self.at = rows[-self.keep :], place[-self.keep :]
        return rows, place, old


PAIR, LISTED = range(2)
LISTS = "kind long, x long, c long, a long, a_size long, b long, b_size long"


def scan_lists(rule: Rule, light: int, band: int = BAND):
    """Of rows sorted by x, c, size, class: pairs (PAIR, a, b) of neighbours in a list that sizes allow, and the rows
    (LISTED, x, c, a) of lists of over band + 1 classes and of all lists that are cut into stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Runs(band + 1)
        for b in gathered(batches, 50_000):
            rows, place, old = lists.extend(*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)))
            n = rows[:, 2] >> CHECK_BITS
            parts = []
            for d in range(1, band + 1):
                j = np.arange(max(old, d), len(rows))
                j = j[place[j] >= d]
                j = j[(rule.den * n[j - d] >= rule.num * n[j]) & (n[j] > light)]
                a, c = rows[j - d], rows[j]
                first = ((a[:, 3] < c[:, 3]) | (a[:, 3] == c[:, 3]) & (a[:, 2] < c[:, 2]))[:, None]
                lo, hi = np.where(first, a[:, 2:], c[:, 2:]), np.where(first, c[:, 2:], a[:, 2:])
                parts.append(np.column_stack([np.full(len(j), PAIR), np.zeros((len(j), 2), np.int64), lo[:, 1], lo[:, 0], hi[:, 1], hi[:, 0]]))
            cut = rows[:, 1] > 0
            long = np.flatnonzero(cut | (place >= band + 1))
            long = long[long >= old]
            head = long[~cut[long] & (place[long] == band + 1)]
            r = rows[np.concatenate([long, *(head - d for d in range(1, band + 2))])]
            parts.append(np.column_stack([np.full(len(r), LISTED), r[:, 0], r[:, 1], r[:, 3], r[:, 2], np.zeros((len(r), 2), np.int64)]))
            got = np.concatenate(parts)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, i])) for i in range(7)], names=[f.split()[0] for f in LISTS.split(", ")])

    return run


def scan_subsets(rule: Rule):
    """Of rows (x, size, class, c) sorted by x, size, class: links (a, b) of each subset's smallest set and the others that it reaches."""
    reach = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (None, 0, 0)
        for b in batches:
            out = []
            for x, size, key, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if x != first[0]:
                    first = (x, size, key)
                elif (size, key) != first[1:]:
                    n, m = first[1] >> CHECK_BITS, size >> CHECK_BITS
                    if reach.setdefault((n, m), rule.overlap(n, m)) <= c:
                        out.append((key, size, first[2], first[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["a", "a_size", "b", "b_size"])

    return run


def numbered(pairs: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """Pairs (a, a_size, b, b_size) of classes as pairs (a, b) of their numbers, with their columns ``more`` as a_ and b_."""
    of = lambda p: classes.select(F.col("class").alias(p), F.col("size").alias(f"{p}_size"), F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in more))
    both = pairs.join(of("a"), ["a", "a_size"]).join(of("b"), ["b", "b_size"])
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *(f"{p}_{c}" for c in more for p in "ab"))


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule, words: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole texts' sets are similar. texts: id, text."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            keep = []
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                for s, t in zip(text_sets(part.column(2), words), text_sets(part.column(3), words), strict=True):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(rule.den * common >= rule.num * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both.mapInArrow(frugal(run), "a long, b long")


def whole_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))


def confirmed(pairs: DataFrame, classes: DataFrame, whole: DataFrame, rule: Rule, words: int) -> tuple[DataFrame, str]:
    """Links among written pairs (a, b) of classes (id, doc_id, row_hash), and their path; texts are fetched for these
    pairs' classes alone."""
    spark, n_pairs = pairs.sparkSession, pairs.count()
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # dealt out anew, not coalesced: that would leave the scan of all classes to as few tasks
    few = classes.join(ends, "id", "left_semi").select("id", "doc_id", "row_hash").repartition(max(1, -(-2 * n_pairs // FILE_ROWS)))
    asked, asked_path = staged(few, "asked")
    maybe = whole.where(may_be_in(asked.select("row_hash"))(F.col("row_hash")))
    found = maybe.join(asked, "row_hash").where(F.col("_doc").eqNullSafe(F.col("doc_id")))
    texts, path = staged(found.select("id", "text").dropDuplicates(["id"]), "class-texts", 2 * n_pairs, TEXT_ROWS)
    links, links_path = staged(verified(pairs, texts, rule, words), "links", n_pairs, TEXT_ROWS)
    remove(spark, path, asked_path)
    return links, links_path


def plausible(pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that the sets' counts allow, of (a, b, a_n, b_n, a_counts, b_counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 10_000):
            (x, kx), (y, ky) = (counts_of(batch.column(i)) for i in (4, 5))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(may_link(rule, na, nb, most, kx & ky)))

    return pairs.select("a", "b", "a_n", "b_n", "a_counts", "b_counts").mapInArrow(frugal(run), "a long, b long")


def in_bands(listed: DataFrame, rule: Rule, tile: int) -> DataFrame:
    """List rows (x, c, id, n) with their band of sizes, and up and down: into how many stretches the list's classes of
    this band and the next are cut, and those of the band before and this. Similar sets are at most one band apart. A
    list of no more than ``tile`` classes is one stretch: up is 0."""
    width = log(rule.den / rule.num) * 1.0001 if rule.num < rule.den else 1.0
    banded = listed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    counts = banded.groupBy("x", "c", "band").agg(F.count(F.lit(1)).alias("k"))
    over = lambda frame: F.expr(f"sum(k) over (partition by x {frame})")
    sizes = counts.withColumn("whole", over("")).withColumn("here", F.expr("sum(k) over (partition by x, band)")).withColumn("after", over("order by band range between current row and 1 following")).withColumn("before", over("order by band range between 1 preceding and current row"))
    parts = lambda c: F.ceil(F.col(c) / tile).cast("int")
    up = F.when(F.col("whole") > tile, parts("after")).otherwise(0)
    down = F.when((F.col("whole") > tile) & (F.col("before") > F.col("here")), parts("before")).otherwise(0)
    return banded.join(sizes.select("x", "c", "band", up.alias("up"), down.alias("down")), ["x", "c", "band"])


def tiles(mixed: DataFrame) -> DataFrame:
    """List rows with band (of the tile), later (whether the row is of the band after it), own (the row's stretch), and i, j: the two stretches that a task compares."""
    tile = lambda band, parts, later: F.struct(band.alias("band"), parts.alias("parts"), F.lit(later).alias("later"))
    alone = F.array(tile(F.lit(-1), F.lit(1), False))
    both = F.array(tile(F.col("band"), F.col("up"), False), tile(F.col("band") - 1, F.col("down"), True))
    rows = mixed.withColumn("t", F.explode(F.when(F.col("up") == 0, alone).when(F.col("down") == 0, F.slice(both, 1, 1)).otherwise(both)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("t.parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t.parts") - 1)))
    return rows.select("x", F.col("t.band").alias("band"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("t.later").cast("int").alias("later"), "id", "component", "n")


TILED = ["x", "band", "i", "j", "own", "later", "id", "component", "n", "counts", "lists"]


def compare_lists(rule: Rule, light: int):
    """Of rows (TILED) sorted by x, band, i, j: pairs (a, b) of different components that sizes and counts allow. lists:
    the least of the lists that a class is in. A pair is given in the least list that both have among those; if they
    have none there, in each list that they share."""

    def compare(x: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        own, later, key, component, n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        counts, known = counts_of(pa.array([r[5] for r in rows], pa.binary()))
        lists = [np.array(r[6], np.int64) for r in rows]
        i, j = own.min(), own.max()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out_a, out_b = [], []

        def elsewhere(p: int, k: int) -> bool:
            both = np.intersect1d(lists[p], lists[k], assume_unique=True)
            return len(both) > 0 and both[0] != x

        for p in left:
            q = right[(component[right] != component[p]) & (rule.den * np.minimum(n[right], n[p]) >= rule.num * np.maximum(n[right], n[p])) & (np.maximum(n[right], n[p]) > light) & (later[right] + later[p] < 2)]
            if i == j:
                q = q[q > p]
            if len(q):
                most = np.minimum(counts[q], counts[p]).sum(axis=1, dtype=np.int64)
                q = q[may_link(rule, n[q], n[p], most, known[q] & known[p])]
                q = q[[not elsewhere(p, k) for k in q]] if len(q) else q
                out_a.append(np.minimum(key[q], key[p])), out_b.append(np.maximum(key[q], key[p]))
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            found = []
            for x, band, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(len(TILED))), strict=True):
                if (x, band, i, j) != at:
                    if len(rows) > 1:
                        found.append(compare(at[0], rows))
                    at, rows = (x, band, i, j), []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(2)], names=["a", "b"])
        if len(rows) > 1:
            a, b = compare(at[0], rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def labelled(listed: DataFrame, components: DataFrame) -> DataFrame:
    """List rows with their class's component, of the lists that hold more than one."""
    named = listed.join(components.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lists = named.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.collect_set(F.struct("c", "band")).alias("cuts")).where("lo <> hi")
    return named.join(lists.select("x", F.explode("cuts").alias("k")).select("x", "k.*"), ["x", "c", "band"], "left_semi")


def class_components(classes: DataFrame, docs: DataFrame, lists: DataFrame, light_pairs: DataFrame, rule: Rule, words: int, light: int, id_col: str, text_col: str, tile: int) -> tuple[DataFrame, str]:
    """(node, component) of all classes that have a link, and the table's path."""
    spark = docs.sparkSession
    entries = lists.where(F.col("kind") == LISTED).select("x", "c", F.col("a").alias("class"), F.col("a_size").alias("size"))
    listed, listed_path = staged(in_bands(entries.join(classes.select("class", "size", "id", "n"), ["class", "size"]).select("x", "c", "id", "n"), rule, tile), "listed", lists.count())
    n_listed = listed.count()
    near = lists.where(F.col("kind") == PAIR).select("a", "a_size", "b", "b_size").distinct()
    numbers = classes.select("id", "n", "counts")
    whole = whole_texts(docs, id_col, text_col)

    def with_counts(pairs: DataFrame) -> DataFrame:
        of = lambda p: numbers.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("counts").alias(f"{p}_counts"))
        return pairs.join(of("a"), "a").join(of("b"), "b")

    pairs, pairs_path = staged(plausible(numbered(near, classes, "n", "counts"), rule), "pairs")
    links, links_path = confirmed(pairs, classes, whole, rule, words)
    components, components_path = connected_components(links.unionByName(numbered(light_pairs, classes)))
    remove(spark, links_path)
    tested, tested_paths = pairs, [pairs_path]
    for step in ("random neighbours", "all that is left"):
        mixed, mixed_path = staged(labelled(listed, components), "mixed-lists", n_listed)
        if mixed.isEmpty():
            remove(spark, mixed_path)
            break
        if step == "random neighbours":
            order = "over (partition by x, c, band order by xxhash64(x, id), id)"
            last = mixed.selectExpr("id", "component", "n", *(f"lag({c}) {order} as last_{c}" for c in ("id", "component", "n")))
            found = last.where("last_component <> component").selectExpr("least(id, last_id) as a", "greatest(id, last_id) as b", "least(n, last_n) as na", "greatest(n, last_n) as nb")
            found = found.where(f"{rule.den} * na >= {rule.num} * nb and nb > {light}").select("a", "b").distinct()
            found = plausible(with_counts(found.join(tested, ["a", "b"], "left_anti")), rule)
        else:
            named = mixed.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("x")), 1, NAMED).alias("lists"))  # of a prefix at most
            rows = tiles(mixed).join(numbers.select("id", "counts").join(named, "id"), "id").select(*TILED)
            rows = rows.repartition("x", "band", "i", "j").sortWithinPartitions("x", "band", "i", "j")
            found = rows.mapInArrow(frugal(compare_lists(rule, light)), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        more, more_path = staged(found, "pairs")
        remove(spark, mixed_path)
        tested_paths.append(more_path)
        if more.isEmpty():
            continue
        tested = tested.unionByName(more)
        links, links_path = confirmed(more, classes, whole, rule, words)
        edges = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
        after, after_path = connected_components(edges)
        remove(spark, links_path, components_path)
        components, components_path = after, after_path
    remove(spark, listed_path, *tested_paths)
    return components, components_path


def by_component(members: DataFrame, classes: DataFrame, components: DataFrame, *consumed: str) -> DataFrame:
    """Rows of ``near_duplicates`` of members (doc_id, row_hash, class, size), classes (class, size, id) and components
    (node, component). The tables at the paths ``consumed`` are deleted."""
    spark = members.sparkSession
    # first by class, then by component: copies and large components are reduced before they are joined
    n_classes = classes.count()
    by_class = members.where("size > 0").groupBy("class", "size").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_hash")).alias("first"))
    named = classes.select("class", "size", "id").join(components.select(F.col("node").alias("id"), "component"), "id", "left").select("class", "size", "id", F.coalesce("component", "id").alias("component"))
    of_class, of_class_path = staged(by_class.join(named, ["class", "size"]), "class-components", n_classes)
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("lead"))
    info, _ = staged(of_class.join(least, "component").select("class", "size", "id", "component_id", "lead"), "class-leads", n_classes)
    remove(spark, of_class_path, *consumed)
    out = members.where("size > 0").join(info, ["class", "size"])
    leads = F.struct("doc_id", "row_hash").eqNullSafe(F.col("lead"))
    full = out.select("doc_id", "row_hash", F.expr(f"size >> {CHECK_BITS}").alias("n_shingles"), F.col("id").alias("class"), "component_id", leads.alias("leads"))
    return full.unionByName(members.where("size = 0").select("doc_id", "row_hash", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"), F.lit(True).alias("leads")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = SHARE_NUM, den: int = SHARE_DEN, cost_ratio: float = COST_RATIO, tile: int = TILE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, row_hash (xxhash64 of the text), n_shingles, class, component_id, leads.

    component_id is the smallest doc_id reachable by links; leads marks the one (doc_id, row_hash) that stands for its
    component. Null or blank text has an empty set and no class, is linked with nothing and stands for itself. Rows that
    repeat id and text are alike in every column. Null ids are passed over for component_id, which is null if there is
    no other. Other columns of ``docs``, whatever their names, aren't looked at; an empty table gives an empty result.
    Very long texts are read in blocks of words, whole."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    rule = Rule(num, den)
    light = rule.light_sizes(cost_ratio)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, words, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col))
    signed_rows, signed_path = staged(rows.mapInArrow(frugal(signatures(rule, words, light, frequent, tile)), SIGNATURES), "signatures")
    of_kind = lambda k: signed_rows.where(F.col("kind") == k)
    one = of_kind(CLASS).groupBy("class", "size").agg(F.min(F.struct("doc_id", "row_hash", "counts")).alias("r"))
    classes, classes_path = staged(one.select("class", "size", F.expr(f"size >> {CHECK_BITS}").alias("n"), F.monotonically_increasing_id().alias("id"), "r.*"), "classes")
    members, members_path = staged(of_kind(MEMBER).select("doc_id", "row_hash", "class", "size"), "members")
    prefixes = of_kind(PREFIX).select("x", "c", "size", "class").repartition("x", "c").sortWithinPartitions("x", "c", "size", "class")
    lists, lists_path = staged(prefixes.mapInArrow(frugal(scan_lists(rule, light)), LISTS), "lists")
    subsets = of_kind(SUBSET).select("x", "size", "class", "c").distinct().repartition("x").sortWithinPartitions("x", "size", "class")
    light_pairs, light_path = staged(subsets.mapInArrow(scan_subsets(rule), "a long, a_size long, b long, b_size long").distinct(), "light-pairs")
    remove(spark, signed_path)
    components, components_path = class_components(classes, docs, lists, light_pairs, rule, words, light, id_col, text_col, tile)
    remove(spark, lists_path, light_path)
    return by_component(members, classes, components, classes_path, components_path)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns.

    Rows that repeat id and text stay together. Null and blank texts stay, as do null ids that lead; an empty table
    stays empty. Only rows that share an id's hash with one that goes are joined; all others pass as they are."""
    gone, _ = staged(near_duplicates(docs, id_col, text_col, **parameters).where("not leads").select("doc_id", "row_hash").distinct(), "gone")
    h, gone_id, gone_hash = free_name(docs, "row_hash", "gone_id", "gone_hash")
    key = F.xxhash64(F.col(id_col).cast("long"))
    maybe = may_be_in(gone.select(F.xxhash64("doc_id")))
    marked = docs.withColumn(h, maybe(key))
    named = gone.select(F.col("doc_id").alias(gone_id), F.col("row_hash").alias(gone_hash))
    same = (F.xxhash64(F.col(text_col)) == F.col(gone_hash)) & F.col(id_col).cast("long").eqNullSafe(F.col(gone_id))
    return marked.where(~F.col(h)).drop(h).unionByName(marked.where(F.col(h)).drop(h).join(named, same, "left_anti"))
