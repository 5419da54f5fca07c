"""Pages as document IR, their sections and chunks, against plain versions and on broken markup."""

from __future__ import annotations

import html
import random
import time

import duckdb

from docloom.operators.context import pack_context
from docloom.operators.sections import section_chunks
from docloom.plans.oracles import ORACLES
from docloom.plans.queries import QUERIES
from docloom.sources.pages import Page, page_ir

CASES = [
    ("<p>a<p>b<br>c</p>d", [("paragraph", "a"), ("paragraph", "b c"), ("paragraph", "d")]),
    ("<h1>A</h1>x<h3>B<p>y</p></h3><h2>C</h2>z", [("heading", "A"), ("paragraph", "x"), ("heading", "B"), ("paragraph", "y"), ("heading", "C"), ("paragraph", "z")]),
    ("<h2><div>in</div></h2>out", [("heading", "in"), ("paragraph", "out")]),
    ("<ul><li>one<li>two <b>bold</b></ul>after", [("list_item", "one"), ("list_item", "two bold"), ("paragraph", "after")]),
    ("<div><ul><li>one</div>after", [("list_item", "one"), ("paragraph", "after")]),
    ("</div></p>x</li></nav>y", [("paragraph", "x"), ("paragraph", "y")]),
    ("<table><tr><td>1<td><h1>2</h1><tr><td><p>3</table>4", [("table", "1 2 3"), ("paragraph", "4")]),
    ("<pre>a\n  b &lt;c&gt;</pre>d", [("code", "a\n  b <c>"), ("paragraph", "d")]),
    ("a < b, 1<2 &amp;&#233;&unknown; &copy", [("paragraph", "a < b, 1<2 &é&unknown; ©")]),
    ('<p title="x > y" class=\'<p>\'>quoted</p>', [("paragraph", "quoted")]),
    ('<p class="open>one</p><p>two', [("paragraph", "one"), ("paragraph", "two")]),
    ("x<!-- <p>no</p> -->y<!doctype html><?pi?>z<!-- open <p>w", [("paragraph", "xyz")]),
    ("<script>var t='</p><p>no';</script><style>p{}</style><textarea><p>no</textarea>yes<SCRIPT>never", [("paragraph", "yes")]),
    ("<nav><ul><li>menu</ul></nav><main>text<aside>ad</aside></main><footer>end", [("paragraph", "text")]),
    ("", []), (" \n\t<p></p><div> </div>", []), ("<", [("paragraph", "<")]), ("<p", []), ("x</", [("paragraph", "x</")]),
]


def test_blocks_of_broken_markup():
    for source, expected in CASES:
        assert [(b["kind"], b["text"]) for b in Page(source, False).blocks] == expected, source
    page = Page("<html data-lang=no LANG=fr><title> A &amp;\n B</title><title>C</title>x<html lang=en>", False)
    assert (page.title, page.language) == ("A & B", "fr")
    assert [(b["text"], b["region"], b["path"]) for b in Page("<h1>A</h1><aside><h2>B</h2>c</aside>d", True).blocks] == [("A", None, [0]), ("B", "aside", []), ("c", "aside", []), ("d", None, [0])]
    assert [b["path"] for b in Page("a<h2>B</h2>c<h4>D</h4>e<h3>F</h3>g<h1>H</h1>i", False).blocks] == [[], [1], [1], [1, 3], [1, 3], [1, 5], [1, 5], [7], [7]]


def test_time_grows_with_length():
    for piece in ("<a '\"", '<a "', "<!--", "<script>", "<div><li>", "</li><ul>", "<", "<h1>", "&", "<pre>a<table>"):
        took = []
        for n in (20_000, 160_000):
            began = time.perf_counter()
            Page(piece * n, True)
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * max(took[0], 0.02), piece  # eight times as long; a square would take 64 times


def plain_chunks(blocks, chars):
    out, key = [], None
    for i, b in enumerate(blocks):
        under = [j for j in b["path"]]
        begin = sum(len(c["text"]) + 1 for c in blocks[:i] if c["path"] == under and c["region"] == b["region"])
        if b["region"]:  # blocks of any region are counted together
            begin = sum(len(c["text"]) + 1 for c in blocks[:i] if c["region"])
        now = (under, b["region"], begin // chars)
        if now != key:
            out.append([])
        key = now
        out[-1].append((i, b["text"]))
    return [(tuple(i for i, _ in c), sum(len(t) for _, t in c)) for c in out]


def test_chunks_by_section(spark):
    rnd = random.Random(7)
    tags = ["<p>", "</p>", "<h1>", "</h1>", "<h2>", "</h2>", "<h3>", "<ul><li>", "</ul>", "<table><td>", "</table>", "<aside>", "</aside>", "<pre>", "</pre>", "<b>", "<!--c-->"]
    rows = [(i, "".join(rnd.choice(tags) + html.escape("wört & " * rnd.randrange(6)) for _ in range(rnd.randrange(60)))) for i in range(80)] + [(90, None), (91, ""), (92, "<p>twice"), (92, "<p>twice"), (93, "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    for regions in (False, True):
        ir = page_ir(pages, regions=regions).cache()
        assert ir.count() == len(rows)
        parsed = {r.page_id: [b.asDict() for b in r.blocks] for r in ir.collect()}
        got = {}
        for r in section_chunks(ir, 40).distinct().collect():
            got.setdefault(r.page_id, []).append((r.chunk, r.first_block, r.last_block, r.n_chars))
        for i, blocks in parsed.items():
            assert [(tuple(range(a, b + 1)), n) for _, a, b, n in sorted(got.get(i, []))] == plain_chunks(blocks, 40), i
    chunked = section_chunks(page_ir(spark.read.schema("page_id long, html string").parquet("/root/testdata/sf0.001/pages.parquet")), 40)
    assert "Exchange" not in chunked._jdf.queryExecution().executedPlan().toString()  # no text is shuffled
    packed = {r.page_id: r for r in pack_context(page_ir(spark.createDataFrame([(1, "<title>T</title><h2>A</h2><p>b</p><table><td>c</table>d")], "page_id long, html string")), 1000).collect()}
    assert packed[1].included_block_indexes == [0, 1] and packed[1].omitted_block_indexes == [2, 3]
    assert packed[1].source_content == 'title: "T"\nlanguage: null\nblock 0 heading 2: "A"\nblock 1 paragraph: "b"\n'
    assert section_chunks(page_ir(pages.limit(0)), 40).count() == 0


def test_references_that_were_cut_off(spark):
    source = "<html lang=d&amp><title>a&amp;&amp</title><p>b&copy;&copy &am &ampx; &#233;&#233 &#xE9;</p>"
    page = Page(source, False, unclosed=False)
    assert (page.title, page.language, [b["text"] for b in page.blocks]) == ("a&&amp", "d&amp", ["b©&copy &am &ampx; é&#233 é"])
    assert (Page(source, False).title, Page(source, False).blocks[0]["text"]) == ("a&&", "b©© &am &x; éé é")
    cut = {r.title for r in page_ir(spark.createDataFrame([(1, source)], "page_id long, html string"), unclosed=False).collect()}
    assert cut == {"a&&amp"}


def test_queries_of_pages_leave_references_that_were_cut_off(spark, tmp_path):
    source = "<html lang=\"de\"><head><title>a &amp;&amp</title></head><body><h1>a &amp;&amp</h1><p>b&quot</p></body></html>"
    spark.createDataFrame([(1, "http://a.test/", source)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("page_blocks", "page_context_pack", "page_sections"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()), name
