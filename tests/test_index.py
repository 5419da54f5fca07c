"""Indexes of vectors and texts, mentions, merges and competing moves against plain versions of themselves."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import mentions, search, state, text_index, vector_index
from docloom.schemas import LEGAL_EDGES, RUN_STATES
from docloom.streaming import streams

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(5)
    spots = rnd.standard_normal((12, 16)) * 3
    rows = [(i, (spots[i % 12] + rnd.standard_normal(16)).tolist(), i % 12) for i in range(900)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(300)]  # a vector that a quarter of all rows have
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [1.0, None] * 8, 0), (3003, [float("nan")] * 16, 0), (3004, [1.0], 0), (None, [1.0] * 16, 0)]
    return spark.createDataFrame(rows, VECTORS).repartition(3).cache()


def test_vector_index_finds_most_neighbours_and_reads_probed_cells(spark, vectors):
    index = vector_index.VectorIndex.build(vectors)
    good = vectors.where("vec_id < 3000")
    assert index.table(spark).count() == good.count()
    asked = good.where("vec_id % 25 = 0")
    exact = search.nearest(good, asked, 10)
    counts = vector_index.recall(index.search(asked, 10), exact).agg(F.sum("found"), F.sum("wanted")).first()
    assert counts[0] >= 0.9 * counts[1] > 0
    everywhere = index.search(asked, 10, probes=10**6, shortlist=130)  # every cell, every vector: nothing can be missed
    key = lambda df: sorted((r.query_id, r.rank, r.score) for r in df.collect())
    assert [k[:2] for k in key(everywhere)] == [k[:2] for k in key(exact)] and all(abs(a[2] - b[2]) <= 1 for a, b in zip(key(everywhere), key(exact), strict=True))
    cell = index.quantizer.probed(vector_index.unit_rows(asked.limit(1).select("embedding").toArrow()["embedding"].combine_chunks(), 16), 1)[0, 0]
    plan = index.table(spark, [int(cell)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*cell#\d+ = {cell}\)", plan)  # folders of other cells aren't listed
    assert all(r.query_id != r.doc_id for r in everywhere.collect())


def test_vector_index_of_little(spark):
    none = spark.createDataFrame([(1, None, 0)], VECTORS)
    assert vector_index.VectorIndex.build(none) is None
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS)
    index = vector_index.VectorIndex.build(one)
    assert index.search(one, 3).count() == 0 and index.search(none, 3).count() == 0
    two = one.withColumn("vec_id", F.lit(7).cast("long"))
    assert [tuple(r) for r in index.search(two, 3).collect()] == [(7, 1, 1000000, 1)]


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(200)]
    text = lambda: " ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(200)], k=rnd.randint(0, 60)))
    return [(i, text(), "ab"[i % 2]) for i in range(n)]


def test_text_index_equals_bm25_through_segments_deletions_and_merges(spark):
    schema = "doc_id long, text string, lang string"
    rows = corpus(400, 1)
    first, second = spark.createDataFrame(rows[:250], schema), spark.createDataFrame([*rows[250:], (500, None, "a"), (501, "  ", None)], schema)
    queries = spark.createDataFrame([(i, t) for i, t, _ in corpus(30, 2)] + [(99, None)], "query_id long, text string")
    found = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    index = text_index.TextIndex(spark)
    with pytest.raises(ValueError, match="no segment"):
        index.documents()
    assert index.add(first, 1, "lang") and not index.add(second, 1, "lang")
    assert found(index.search(queries, 5)[0]) == found(search.bm25(first, queries, 5))
    old = {f for f in index._read("postings").inputFiles()}
    index.add(second, 2, "lang")
    assert old < {f for f in index._read("postings").inputFiles()}  # an added batch leaves the rest as it is
    both = first.unionByName(second)
    results, report = index.search(queries, 5, first=1)
    assert found(results) == found(search.bm25(both, queries, 5))
    counts = report.agg(F.sum("blocks"), F.sum("scored")).first()
    assert counts[1] < counts[0]
    newer = spark.createDataFrame([(i, t + " wca wda", x) for i, t, x in rows[:40]] + [(41, None, "a")], schema)
    index.add(newer, 3, "lang")
    index.delete(spark.createDataFrame([(60,), (10,)], "doc_id long"), 2)  # 10 has come again since
    now = both.where("doc_id >= 40 and doc_id not in (41, 60)").unionByName(newer)
    assert found(index.search(queries, 5)[0]) == found(search.bm25(now, queries, 5))
    assert index.merge([1, 2, 3], 4)
    assert index.documents().where("not live").count() == 0
    assert found(index.search(queries, 5)[0]) == found(search.bm25(now, queries, 5))
    index.delete(spark.createDataFrame([(100,)], "doc_id long"), 4)
    assert found(index.search(queries, 5)[0]) == found(search.bm25(now.where("doc_id <> 100"), queries, 5))


def shuffled(spark, step):
    """Records that the step's stages wrote to shuffles."""
    sc = spark.sparkContext
    gateway, context = sc._gateway, sc._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        lists = gateway.jvm.java.util.ArrayList
        stages = context.statusStore().stageList(lists(), False, False, gateway.new_array(gateway.jvm.double, 0), lists())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    step()
    return written() - before


def test_text_index_shuffles_documents_and_blocks_not_terms_and_hits(spark):
    docs = spark.createDataFrame(corpus(400, 6), "doc_id long, text string, lang string")
    queries = spark.createDataFrame([(i, t) for i, t, _ in corpus(60, 7)], "query_id long, text string")
    terms = search.postings(docs).count()
    index = text_index.TextIndex(spark)
    assert shuffled(spark, lambda: index.add(docs, 1, "lang")) <= 4 * 400 < terms / 2  # before: twice the terms and more
    index.add(docs.where("doc_id % 5 = 0"), 2, "lang")
    assert shuffled(spark, lambda: index.search(queries, 5)[0].collect()) < 60 * 400 / 2  # nearly all pairs are hits
    assert shuffled(spark, lambda: index.merge([1, 2], 3)) < terms / 2


def test_text_index_takes_rows_of_one_document_as_one(spark):
    rows = [(1, "b a b", "en"), (1, "a c", "de"), (1, None, "en"), (2, None, None), (2, "", "x"), (3, "c", "en"), (None, "a", "en")]
    index = text_index.TextIndex(spark)
    index.add(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1, "lang")
    found = {(r.token, i, tf, n) for r in index._read("postings").collect() for i, tf, n in zip(r.ids, r.tfs, r.lengths, strict=True)}
    assert found == {("a", 1, 2, 5), ("b", 1, 2, 5), ("c", 1, 1, 5), ("c", 3, 1, 1)}
    assert {(r.doc_id, r.length) for r in index.documents().collect()} == {(1, 5), (2, 0), (3, 1)}


def test_queries_of_many_words_go_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(120, 3), "doc_id long, text string, source string")
    queries = spark.createDataFrame([(i, t, s) for i, t, s in corpus(20, 4)], "query_id long, text string, source string")
    whole = [sorted(search.bm25(docs, queries, 4, scope).collect()) for scope in (None, "source")]
    monkeypatch.setattr(search, "ASKED", 60)
    monkeypatch.setattr(search, "HIT_CELLS", 50)
    assert [sorted(search.bm25(docs, queries, 4, scope).collect()) for scope in (None, "source")] == whole
    assert all(r.doc_id % 2 == r.query_id % 2 for r in search.bm25(docs, queries, 4, "source").collect())


def plain_matches(tokens, aliases):
    spans = [(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if " ".join(tokens[i : j + 1]) in aliases]
    return sorted((i, j, " ".join(tokens[i : j + 1])) for i, j in spans if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b in spans))


@pytest.mark.parametrize("most", [10**6, 4])
def test_mentions_are_the_longest(spark, most):
    rnd = random.Random(3)
    aliases = sorted({" ".join(rnd.choices("abcd", k=rnd.choice([1, 2, 2, 3, 4]))) for _ in range(14)} | {"new york", "york", "new york city", "é à"})
    texts = [(i, " ".join(rnd.choices("abcd", k=40))) for i in range(30)] + [(40, "New York, city of York; new-york city"), (41, None), (42, "É À"), (43, ""), (44, "ab abc")]
    table = spark.createDataFrame([(a, a.upper()) for a in aliases], "alias string, entity string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in mentions.matches(docs, table, most).collect():
        got.setdefault(r.doc_id, []).append((r["first"], r["last"], r["alias"]))
    plain = {i: plain_matches(re.findall(r"[^\W\d_]+", (t or "").lower()), set(aliases)) for i, t in texts}
    assert {i: sorted(m) for i, m in got.items()} == {i: m for i, m in plain.items() if m}
    counts = mentions.text_mentions(docs, table, most)
    assert {(r.alias, r.entity, r.mentions) for r in counts.where("doc_id = 40").collect()} == {("new york city", "NEW YORK CITY", 2), ("york", "YORK", 1)}
    assert mentions.matches(docs, table.limit(0), most).count() == 0


def test_mentions_take_time_apart_from_the_number_of_aliases(spark, tmp_path):
    rnd = random.Random(5)
    n, edge = 100_000, 1 << 16  # where the finder begins anew in a long text
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = []
    for doc in range(20):
        words = [w for i in (rnd.randrange(2, 2 * n) for _ in range(50_000)) for w in (name(i), name(i + rnd.choice([1, 2])))]
        words[edge - 1 : edge + 1] = [name(0), name(1)]
        texts.append((doc, words))
    spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(8).write.parquet(f"file://{tmp_path}/docs")
    spark.createDataFrame([(f"{name(i)} {name(i + 1)}",) for i in range(0, 2 * n, 2)], "alias string").write.parquet(f"file://{tmp_path}/aliases")
    second = {name(i): name(i + 1) for i in range(0, 2 * n, 2)}
    wanted = [(doc, i, i + 1, f"{w} {words[i + 1]}") for doc, words in texts for i, w in enumerate(words[:-1]) if second.get(w) == words[i + 1]]
    docs, table = (spark.read.parquet(f"file://{tmp_path}/{t}") for t in ("docs", "aliases"))
    took = []
    for aliases in (table.where("alias like 'aaa%'"), table):
        began = time.monotonic()
        got = mentions.matches(docs, aliases).toPandas()
        took.append(time.monotonic() - began)
    assert sorted(got.itertuples(index=False, name=None)) == wanted and sum(m[1] == edge - 1 for m in wanted) == 20
    assert took[1] < 3 * took[0]  # an automaton's root has 100,000 branches, looked at one by one for each token


@pytest.mark.parametrize("most", [10**6, 4])
def test_mentions_read_texts_once(spark, most):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(3)], "doc_id long, text string")
    table = spark.createDataFrame([(a,) for a in "abcdefghij"], "alias string")
    found = mentions.matches(docs, table, most)
    assert found.count() == 12
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_mentions_apart_and_meeting_are_counted(spark):
    docs = spark.createDataFrame([(1, "a b c x a y c b a b c a"), (2, "b c b"), (3, "x"), (4, "A b-C")], "doc_id long, text string")
    table = spark.createDataFrame([("a", "A"), ("a b", "AB"), ("b c", "BC"), ("c", "C"), ("c", "C2"), ("d", "D"), ("", "E"), (None, "F")], "alias string, entity string")
    got = sorted(tuple(r) for r in mentions.text_mentions(docs, table).collect())
    assert got == [(1, "a", "A", 2), (1, "a b", "AB", 2), (1, "b c", "BC", 2), (1, "c", "C", 1), (1, "c", "C2", 1), (2, "b c", "BC", 1), (4, "a b", "AB", 1), (4, "b c", "BC", 1)]


def test_page_aliases(spark):
    pages = spark.createDataFrame([("http://a.shop.co.uk/x?q", "<title>Red Fish</title><a href=\"/in\">The Inn</a><a href=\"https://www.other.org/y\">other</a>"), ("http://b.shop.co.uk/z", "<a href=\"/out\">the inn</a><a href=\"/out\">the INN!</a>"), ("nothing", None), ("http://c.org", None)], "url string, html string")
    got = {(r["alias"], r["entity"]) for r in mentions.page_aliases(pages).collect()}
    assert got == {("red fish", "a.shop.co.uk/x"), ("the inn", "shop.co.uk/out"), ("other", "other.org"), ("a shop co uk", "shop.co.uk"), ("b shop co uk", "shop.co.uk"), ("c org", "c.org")}


def test_merges_resolve_chains_circles_and_versions(spark):
    log = [(1, "a", "b", False), (2, "b", "c", False), (3, "x", "y", False), (4, "y", "x", False), (5, "c", "c", False), (6, "p", "x", False), (7, "b", "c", True), (8, "b", "d", False), (9, "a", "e", False), (10, "a", "e", True)]
    merges = spark.createDataFrame(log, "version long, entity string, into string, undone boolean")
    names = spark.createDataFrame([(n,) for n in "abcdexyp"], "entity string")

    def plain(version):
        edges = {}
        for v, e, i, undone in sorted(log):
            if v <= version and e != i:
                edges.setdefault(e, {})
                edges[e].pop(i, None) if undone else edges[e].update({i: v})
        now = {e: max(m, key=m.get) for e, m in edges.items() if m}

        def end(x):
            path = [x]
            while x in now:
                x = now[x]
                if x in path:
                    return min(path[path.index(x) :])
                path.append(x)
            return x

        return {n: end(n) for n in "abcdexyp"}

    for version in (0, 1, 2, 4, 6, 7, 8, 9, 10):
        got = {r.entity: r.merged for r in mentions.merged_entities(names, merges, version).collect()}
        assert got == plain(version), version
    assert plain(10)["a"] == "d" and plain(7)["a"] == "b"
    chain = [(i, f"n{i:03}", f"n{i + 1:03}", False) for i in range(100)]
    long = mentions.resolved(spark.createDataFrame(chain, merges.schema))
    assert {r.merged for r in long.collect()} == {"n100"} and long.count() == 100


@pytest.mark.parametrize("part", [3, 256])
def test_competing_moves_have_one_winner(spark, part):
    rnd = random.Random(8)
    states = {run: rnd.choice(RUN_STATES) for run in range(12)}
    moves = [(run, turn, rnd.choice(RUN_STATES), rnd.choice(RUN_STATES)) for run in range(14) for turn in range(60)]
    moves += [(run, turn, *rnd.choice(LEGAL_EDGES)) for run in range(14) for turn in range(60, 160)] + [(1, 7, None, "failed")]
    got = state.compare_and_set(spark.createDataFrame(list(states.items()), "run_id long, state string"), spark.createDataFrame(moves, "run_id long, turn long, expected_state string, to_state string"), "turn", part)
    now, wanted = dict(states), []
    for run, turn, expected, to in sorted(moves, key=lambda m: (m[0], m[1], m[2] or "", m[3])):
        changed = run in now and now[run] == expected and (expected, to) in LEGAL_EDGES
        if changed:
            now[run] = to
        wanted.append((run, turn, now.get(run), changed))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))
    assert sum(w[3] for w in wanted) > 12


def test_streams_read_tables_in_folders_and_of_nothing(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/whole/events.parquet")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(streams.windowed_counts(spark, f"file://{tmp_path}/whole")) == key(streams.windowed_counts(spark, sf_dir))
    (tmp_path / "none").mkdir()
    waiting = spark.readStream.schema("user_id long, event_type string, ts timestamp, value double").parquet(f"file://{tmp_path}/none")
    assert streams.drained(streams.count_windows(waiting), "update", ["window_start", "event_type"]).count() == 0


def test_python_workers_get_small_batches(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    docs = spark.createDataFrame([(i, "new york") for i in range(4)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")
    calls = [lambda: search.bm25(docs, docs.withColumnRenamed("doc_id", "query_id"), 2), lambda: search.nearest(vectors, vectors, 2), lambda: mentions.matches(docs, docs.select(F.col("text").alias("alias")))]
    for call in calls:
        for name in names:
            spark.conf.set(name, str(1 << 30))
        assert call().count() and all(int(spark.conf.get(n)) <= most for n, most in zip(names, (1000, 8 << 20), strict=True))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    for wide, rows in ((1, 3000), (1 << 20, 40)):
        found = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), wide).alias("text")).mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == rows and max(r.n for r in found) <= 1000 and max(r.size for r in found) <= 10 << 20
