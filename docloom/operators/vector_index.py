"""An approximate index of vectors by cosine: cells, product-quantised codes, exact re-ranking.

Vectors are scaled to length one. Coarse centroids part space into cells; what a vector differs by from its cell's
centroid is cut into parts of few components, each named by the nearest of 256 codewords. Centroids and codewords are
fitted by k-means on a bounded sample (``sample`` vectors of the least hashes of their ids), every vector is indexed. How
many cells a query has to probe is measured on the same sample: enough to hold ``target`` of the true neighbours.

The index is a table partitioned by cell: id, code and vector, dealt by ranges of cell and id, so that a cell with a
third of all rows is many tasks' work and many files. A search reads the codes of probed cells alone, compares blocks of
queries with blocks of codes of the same cell, keeps a shortlist of each query, and reads its vectors to rank it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import ranked
from docloom.sources.stage import work_path

#: Vectors that the fit looks at, at most, and of those the ones that it takes for queries.
SAMPLE, TRIED = 20_000, 200
#: Most cells, codewords of a part, components of a part, rounds of k-means.
CELLS, WORDS, PART, ROUNDS = 4_096, 256, 2, 8
#: Codes of a block, queries of a group, parts into which a group's codes are dealt.
CODE_BLOCK, QUERY_GROUP, PARTS = 1_024, 1_024, 4
#: Entries of a query's shortlist for each result that it wants.
SHORTLIST = 10


def unit_rows(column: pa.Array, length: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector of the rows whose vector has a cosine: no null in it, finite, not all zero."""
    v = F.col(vector_col)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.coalesce((square > 0) & (square < float("inf")) & F.col(id_col).isNotNull(), F.lit(False))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rnd: np.random.Generator) -> np.ndarray:
    """Centres of a sample's rows."""
    centres = x[rnd.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = nearest_rows(x, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class Quantizer:
    """What tasks need to know: cells' centroids, codewords of each part, and the cells to probe."""

    centres: np.ndarray
    words: list[np.ndarray]
    probes: int

    @property
    def length(self) -> int:
        return self.centres.shape[1]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, near: int, target: float, seed: int = 7) -> Quantizer:
        """``near`` neighbours in the sample of each tried row are to be in probed cells, as a share of ``target``."""
        rnd = np.random.default_rng(seed)
        centres = k_means(x, min(cells, len(x)), rnd)
        cell = nearest_rows(x, centres)
        rest = x - centres[cell]
        words = [k_means(rest[:, i : i + PART], min(WORDS, len(x)), rnd) for i in range(0, x.shape[1], PART)]
        tried = rnd.permutation(len(x))[:TRIED]
        cosine = x[tried] @ x.T
        cosine[np.arange(len(tried)), tried] = -2
        found = np.argsort(-cosine, axis=1)[:, : max(1, min(near, len(x) - 1))]
        place = np.argsort(np.argsort(-(x[tried] @ centres.T), axis=1), axis=1)  # of each cell among a query's cells
        needed = np.sort(np.take_along_axis(place, cell[found], axis=1).reshape(-1)) + 1
        return cls(centres, words, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]))

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_rows(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([nearest_rows(rest[:, p * PART : (p + 1) * PART], w) for p, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([w[codes[:, p]] for p, w in enumerate(self.words)], axis=1)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]


@dataclass
class VectorIndex:
    path: str
    quantizer: Quantizer
    vector_type: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, near: int = 10, target: float = 0.97, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex | None:
        """Writes the index of all usable vectors; None if there are none. Vectors of another length than the first of
        the sample are left out, as are null ids; of repeated ids each row is indexed. There are as many cells as the
        root of the number of vectors, unless ``cells`` says otherwise."""
        rows = usable(vectors, id_col, vector_col)
        held = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()  # bounded
        if not len(held):
            return None
        length = len(held[0])
        held = held.filter(pa.array(held.value_lengths().to_numpy() == length))
        rows = rows.where(F.size("vector") == length)
        cells = cells or max(1, min(CELLS, round(rows.count() ** 0.5)))
        quantizer = Quantizer.fit(unit_rows(held, length), cells, near, target)
        kind = rows.schema["vector"].dataType.simpleString()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, codes = quantizer.encoded(unit_rows(b.column(1), length))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), packed, b.column(1)], names=["cell", "id", "code", "vector"])

        coded = rows.mapInArrow(encode, f"cell int, id long, code binary, vector {kind}")
        path = path or work_path(vectors.sparkSession, "vector-index")
        coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(path)
        return cls(path, quantizer, kind)

    def table(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """cell, id, code, vector, of these cells alone: a filter of folders."""
        rows = spark.read.schema(f"id long, code binary, vector {self.vector_type}, cell int").parquet(self.path)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def asked(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """nearest (cell), query_id, query (its unit vector's bytes) of each query, repeated rows once."""
        quantizer = self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = unit_rows(b.column(1), quantizer.length)
                cell = quantizer.probed(q, 1)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), pa.array([v.tobytes() for v in q], pa.binary())], names=["nearest", "query_id", "query"])

        rows = usable(queries, id_col, vector_col).where(F.size("vector") == quantizer.length)
        return rows.mapInArrow(run, "nearest int, query_id long, query binary").distinct()

    def grouped(self, asked: DataFrame) -> DataFrame:
        """grp, query_id, query: queries in groups of about QUERY_GROUP, those of near cells together; a cell that is the
        nearest of more queries is dealt to several groups."""
        counts = {r.nearest: r["count"] for r in asked.groupBy("nearest").count().collect()}  # at most CELLS numbers
        centres = self.quantizer.centres
        axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
        filled, rows = 0, []
        for cell in sorted(counts, key=lambda c: (float(centres[c] @ axis), c)):
            rows.append((cell, filled // QUERY_GROUP, -(-counts[cell] // QUERY_GROUP)))
            filled += counts[cell]
        places = asked.sparkSession.createDataFrame(rows, "nearest int, first int, parts int")
        grp = (F.col("first") + F.pmod(F.xxhash64("query_id", "query"), F.col("parts"))).cast("int")
        return asked.join(F.broadcast(places), "nearest").select(grp.alias("grp"), "query_id", "query")  # at most CELLS rows

    def probed_cells(self, groups: DataFrame, probes: int) -> DataFrame:
        """grp, cell: the cells that queries of a group probe."""
        quantizer = self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                grp = b.column(0).to_numpy()
                q = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(len(grp), -1)
                cell = quantizer.probed(q, probes)
                both = np.unique(np.stack([np.repeat(grp, cell.shape[1]), cell.reshape(-1)], axis=1), axis=0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["grp", "cell"])

        return groups.select("grp", "query").mapInArrow(run, "grp int, cell int").distinct()

    def search(self, queries: DataFrame, k: int, probes: int | None = None, shortlist: int = SHORTLIST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """query_id, doc_id, score (cosine in millionths), rank: k near others of each query, of the cells that it
        probes; scores are exact, a neighbour may be missed. A query without a cosine has no row.

        Codes go to groups of queries: a task has a group's queries first, then the blocks of codes of one in PARTS of
        the cells that the group probes, and holds each query's shortlist. So a query leaves PARTS shortlists, however
        many vectors, cells and tasks there are."""
        quantizer, probes = self.quantizer, min(probes or self.quantizer.probes, len(self.quantizer.centres))
        groups = self.grouped(self.asked(queries, id_col, vector_col))
        pairs = self.probed_cells(groups, probes)
        cells = sorted(r.cell for r in pairs.select("cell").distinct().collect())  # at most CELLS numbers
        table = self.table(queries.sparkSession, cells)
        blocks = table.select("cell", "id", "code").mapInArrow(packed(CODE_BLOCK), "cell int, ids binary, data binary")
        dealt = blocks.join(pairs, "cell").select("grp", F.pmod(F.xxhash64("cell", "ids"), F.lit(PARTS)).cast("int").alias("part"), "cell", F.lit(None).cast("long").alias("query_id"), "ids", "data")
        wanted = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(-1).alias("cell"), "query_id", F.lit(None).cast("binary").alias("ids"), F.col("query").alias("data"))
        rows = wanted.unionByName(dealt).repartition("grp", "part").sortWithinPartitions("grp", "part", "cell", "query_id", "ids")
        keep = k * shortlist

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, names, raw, lists = None, [], [], None
            for batch in batches:
                for grp, part, cell, query, ids, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if (grp, part) != key:
                        if lists is not None:
                            yield lists.batch()
                        key, names, raw, lists = (grp, part), [], [], None
                    if cell < 0:
                        names.append(query), raw.append(data)
                        continue
                    if lists is None:
                        lists = Shortlists(quantizer, np.array(names), np.frombuffer(b"".join(raw)).reshape(len(names), -1), probes, keep)
                    lists.add(cell, np.frombuffer(ids, np.int64), np.frombuffer(data, np.uint8))
            if lists is not None:
                yield lists.batch()

        scored = rows.mapInArrow(score, "query_id long, doc_id long, cell int, score double")
        first = scored.withColumn("place", F.expr("row_number() over (partition by query_id order by score desc, doc_id)")).where(F.col("place") <= keep).select("query_id", "doc_id", "cell")
        named = usable(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("vector").alias("query")).distinct()
        both = first.join(table.select("cell", F.col("id").alias("doc_id"), "vector"), ["cell", "doc_id"]).join(named, "query_id").select("query_id", "doc_id", "query", "vector")

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cosine = (unit_rows(b.column(2), quantizer.length) * unit_rows(b.column(3), quantizer.length)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(cosine * 1e6).astype(np.int64))], names=["query_id", "doc_id", "score"])

        return ranked(both.mapInArrow(rank, "query_id long, doc_id long, score long"), k)


class Shortlists:
    """The ``keep`` best codes so far of each of a group's queries; the least of them is the bar that others must pass."""

    def __init__(self, quantizer: Quantizer, names: np.ndarray, queries: np.ndarray, probes: int, keep: int) -> None:
        self.quantizer, self.names, self.queries = quantizer, names, queries
        self.probes = np.zeros((len(names), len(quantizer.centres)), bool)
        np.put_along_axis(self.probes, quantizer.probed(queries, probes), True, axis=1)
        self.score = np.full((len(names), keep), -np.inf)
        self.doc, self.cell = np.zeros((len(names), keep), np.int64), np.zeros((len(names), keep), np.int32)

    def add(self, cell: int, doc: np.ndarray, codes: np.ndarray) -> None:
        at = np.flatnonzero(self.probes[:, cell])
        near = self.queries[at] @ self.quantizer.decoded(cell, codes.reshape(len(doc), -1)).T
        near[self.names[at][:, None] == doc[None, :]] = -np.inf
        over = (near > self.score[at].min(axis=1)[:, None]).any(axis=1)
        at, near = at[over], near[over]
        keep = self.score.shape[1]
        score = np.concatenate([self.score[at], near], axis=1)
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        docs = np.concatenate([self.doc[at], np.broadcast_to(doc, near.shape)], axis=1)
        cells = np.concatenate([self.cell[at], np.full(near.shape, cell, np.int32)], axis=1)
        self.score[at], self.doc[at], self.cell[at] = (np.take_along_axis(c, best, axis=1) for c in (score, docs, cells))

    def batch(self) -> pa.RecordBatch:
        found = np.isfinite(self.score)
        names = np.repeat(self.names, found.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(self.doc[found]), pa.array(self.cell[found]), pa.array(self.score[found])], names=["query_id", "doc_id", "cell", "score"])


def packed(size: int):
    """For mapInArrow: rows (cell, id, bytes of one length), together by cell, as blocks (cell, ids, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(cell: int) -> pa.RecordBatch:
            ids, data = held.pop(cell)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())], names=["cell", "ids", "data"])

        for b in batches:
            for cell, i, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if cell not in held and len(held) >= 8:  # cells that are over come first
                    yield block(next(iter(held)))
                ids, data = held.setdefault(cell, ([], []))
                ids.append(i), data.append(raw)
                if len(ids) >= size:
                    yield block(cell)
        for cell in list(held):
            yield block(cell)

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found: how many of the exact results of each query an approximate search has given. A result of
    the same score as the last exact one counts as well."""
    least = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.min("score").alias("least"))
    hits = found.join(least, "query_id").where("score >= least").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return least.join(hits, "query_id", "left").select("query_id", "wanted", F.least("wanted", F.coalesce("found", F.lit(0).cast("long"))).alias("found"))
