"""The pipeline's stages on the small table against plain versions, and the queries against their SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from docloom.llm import queries
from docloom.llm._shared import staged


def plain_survivors(texts: dict[int, str]) -> set[int]:
    """The smallest id of each group of texts linked by a similarity of 0.8 of their sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row_hash string, maybe string, found string, lang_pred string, score string, kept_text string, length string"


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf_dir):
    item = next(r.text for r in queries.table(spark, sf_dir, "benchmark").orderBy("item_id").collect() if len((r.text or "").split()) > 10)
    story = "once there was a house on a hill and nobody knew who had built it or when or why so all kept away from it"
    texts = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !"), (5, story), (6, story.upper()), (6, story.upper()), (7, story + " still"), (8, f"before {item.upper()} after"), (None, story), (None, None), (9, "x " * 20_000 + "y")]
    rows = [(i, t, None, None, None, *["x"] * 8) for i, t in texts]
    docs = spark.createDataFrame(rows, COLUMNS)
    some = lambda k, df=docs: sorted((r.doc_id or 0, (r.text or "")[:60]) for r in corpus_pipeline.STAGES[k][1](spark, df, sf_dir).collect())
    first = lambda *ids: sorted((i or 0, (t or "")[:60]) for i, t in texts if i in ids)
    assert some(0) == sorted((i or 0, (t or "")[:60]) for i, t in texts if any(c.isalpha() for c in t or ""))  # nothing was learned
    assert some(1) == sorted([(2, ""), (3, " \n"), (4, "12 34 !"), (6, story.upper()[:60]), (7, story[:60]), (8, f"before {item.upper()} after"[:60]), (9, ("x " * 30))])
    near = some(2)
    assert [r for r in near if r[0] in (1, 2, 3, 4, 8, 9)] == [r for r in sorted((i or 0, (t or "")[:60]) for i, t in texts) if r[0] in (1, 2, 3, 4, 8, 9)]
    assert sum(t.lower() == story[:60] for _, t in near) == 1  # one row leads the group of the story
    assert some(3) == sorted((i or 0, (t or "")[:60]) for i, t in texts if i != 8)
    assert first(8) and sorted({(r.doc_id or 0) for r in corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()}) == [0, *range(1, 10)]
    nothing = docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, nothing, sf_dir)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_stages_drop_what_they_should(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    out, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = staged(stage(spark, out, sf_dir), "test-stage")
        assert after.columns == docs.columns
        before, left = ({r.doc_id: r.text for r in x.collect()} for x in (out, after))
        assert set(left) <= set(before)
        seen.append((name, before, left))
        out = after
    by = {name: (before, left) for name, before, left in seen}
    before, left = by["language ID"]
    letterless = {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
    assert letterless.isdisjoint(left) and len(left) >= 0.99 * (len(before) - len(letterless))
    before, left = by["exact dedup"]
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    assert set(left) == set({fold(t): i for i, t in sorted(before.items())}.values())
    before, left = by["near dedup"]
    assert set(left) == plain_survivors(before)
    before, left = by["decontamination"]
    items = [r.text for r in queries.table(spark, sf_dir, "benchmark").collect()]
    assert all(i not in left for i, t in before.items() if any(x in t for x in items))
    assert len(left) > 0.9 * len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(left)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    found = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(found.columns)
    expected = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[c] for c in columns]) for r in expected)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
