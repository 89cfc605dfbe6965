"""Pages in storage format: what each rule gives, what is refused, and that no page stops a job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.storage import MAX_REFERENCES, MAX_ROWS, convert, encoded, grid, storage_pages
from tessera.operators import relations


def macro(name: str, *inner: str) -> str:
    return f'<ac:structured-macro ac:name="{name}">{"".join(inner)}</ac:structured-macro>'


def parameter(name: str, value: str) -> str:
    return f'<ac:parameter ac:name="{name}">{value}</ac:parameter>'


RICH, PLAIN = "<ac:rich-text-body>{}</ac:rich-text-body>", "<ac:plain-text-body>{}</ac:plain-text-body>"

SHOWN = {
    "headings and rules": ("<h3> a </h3><hr/><p>b<br/>c</p>", "### a\n\n---\n\nb\nc"),
    "marks in text": ("<p>2*3_4\\5</p>", "2\\*3\\_4\\\\5"),
    "entities": ("<p>&auml;&amp;&lt;&#65;</p>", "ä&<A"),
    "composed": ("<p>Zoë</p>", "Zoë"),
    "sections are borders": ("<div>a<section>b</section></div><ac:layout><ac:layout-cell>c</ac:layout-cell></ac:layout>", "a\n\nb\n\nc"),
    "spans are none": ("<p>H<sub>2</sub>O <span>x</span></p>", "H2O x"),
    "code in a line": ("<p><code>a``b\nc</code> <code>`</code></p>", "```a``b c``` ``` ` ```"),
    "code in a block": ("<pre>x\n````\ny</pre>", "`````\nx\n````\ny\n`````"),
    "lists": ("<ul>no<li>one<ol><li>in</li><li>deep<ul><li>er</li></ul></li></ol> more</li><li><p>two</p><p>three</p></li></ul>", "- one more\n  1. in\n  2. deep\n    - er\n- two\n\n  three"),
    "list in a paragraph begins anew": ("<ul><li><p><ul><li>x</li></ul></p></li></ul>", "- - x"),
    "quote": ("<blockquote>a<p>b</p></blockquote>", "> a\n>\n> b"),
    "a plain table": ("<table>t<thead><tr><th>a|b</th><th> c\nd </th></tr></thead><tr>x<td>1</td><p>no</p><td/></tr></table>", "| a\\|b | c d |\n| --- | --- |\n| 1 |  |"),
    "joined cells": ("<table><tr><td colspan='2'>a</td><td rowspan='2'>b</td></tr><tr><td>c</td><td>d|\\e</td></tr></table>", "| a [colspan:2] |  | b [rowspan:2] |\n| --- | --- | --- |\n| c | d\\|\\\\e |  |"),
    "rows of unequal length": ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "| a | b |\n| --- | --- |\n| c |  |"),
    "a cell too high": ("<table><tr><td rowspan='3'>a</td></tr><tr><td>b|c</td></tr></table>", "[table]\nrow[0]: a\nrow[1]: b\\|c"),
    "an empty table": ("<table><caption>x</caption></table>", "[table]\nrow[0]:"),
    "parts of tables alone": ("<tr><td>a</td></tr>", "a"),
    "links": ("<a href='mailto:a b@c)'>x</a><a>y</a><a href='ftp://z'>z</a><a href='/q'/>", "[x](mailto:a%20b@c\\))yz[link](/q)"),
    "a link to a file": ("<ac:link><ri:attachment ri:filename='a\t[b].pdf'/><b>no</b></ac:link>", "[media: a \\[b\\].pdf]"),
    "a link of another kind": ("<ac:link><b>yes</b></ac:link>", "**yes**"),
    "scripts": ("<style>p{}</style><blink/>", "[unsupported:style omitted][unsupported:blink]"),
    "code macro": (macro("code", parameter("language", "sql"), parameter("title", "a*"), PLAIN.format("<![CDATA[<a> & ``` ]]>"), PLAIN.format("no")), "**a\\***\n\n````sql\n<a> & ```\n````"),
    "expand": (macro("Expand", parameter("title", " T "), RICH.format("<p>x</p>"), PLAIN.format("no")), "**T**\n\nx"),
    "excerpt": ("a" + macro("excerpt", RICH.format("b"), RICH.format("no")) + "c", "abc"),
    "notice": (macro("warning", RICH.format("<p>x</p><p>y</p>")), "> **Warning:**\n> x\n>\n> y"),
    "included": (macro("include", "<p>no</p><ac:link><ri:page ri:content-title='A'/></ac:link>"), "[included from page: A]"),
    "included by parameter": (macro("excerpt-include", parameter("title", "t"), parameter("page", "p")), "[included from page: p]"),
    "diagram": (macro("drawio-board", parameter("diagramName", ""), parameter("name", "d")), "[diagram: d]"),
    "diagram by file": (macro("drawio", "<ri:attachment ri:filename='f'/>"), "[diagram: f]"),
    "issue": (macro("jira", parameter("key", " AB-7 ")) + macro("jira", parameter("key", "AB-07")), "AB-7[jira-issue]"),
    "contents": ("a" + macro("toc", parameter("x", "y")), "a"),
    "an unknown macro": (macro("odd one", RICH.format("<p>a</p>"), PLAIN.format("b*"), RICH.format("c")), "[macro:unknown]\n\na\n\nb\\*\n\nc"),
}


@pytest.mark.parametrize("name", SHOWN)
def test_markdown(name):
    body, want = SHOWN[name]
    assert convert(body)["text"] == want


@pytest.mark.parametrize(
    ("body", "fault"),
    [
        ("<!doctype x><p/>", "forbidden declaration"), ("<p/><! ENTITY a>", "forbidden declaration"), ("&nothing;", "unknown entity"), ("<b><i></b></i>", "malformed"), ("<zz:p/>", "malformed"),
        ("</page><page>", "malformed"), ("\x07", "malformed"), ("a < b", "malformed"), ("<img/>" * (MAX_REFERENCES + 1), "reference intent limit"), (f"<table>{'<tr><td/></tr>' * (MAX_ROWS + 1)}</table>", "table exceeds"),
        (f"<table><tr><td rowspan='x'>{'y' * 65_537}</td></tr></table>", "table cell exceeds"), (f"<table>{f'<tr><td rowspan=" "/><td>{chr(233) * 30_000}</td></tr>' * 20}</table>", "table output exceeds"),
        ("<p><table>" + "<tr><td/></tr>" * 300 + "</table>", "malformed"),
    ],
)
def test_refused(body, fault):
    out = convert(body)
    assert fault in out.pop("fault") and not out


def test_told_in_the_order_of_the_result():
    """What a hidden part holds is not told; a list's references follow those of the item's own text."""
    body = (
        "<ul><li><ul><li><img alt='2'/></li></ul><img alt='1'/></li></ul><blink/>" + macro("odd", RICH.format("<wink/>")) + macro("drawio", parameter("name", "3"), "<img alt='no'/><blink/>")
        + "<ac:link><ri:page/><ac:image alt='4'/></ac:link><ac:link><ri:attachment ri:filename='5'/><img alt='no'/></ac:link><a href='/pages/9/x'><img alt='6'/></a><a href='//h/pages/9'>h</a>" + macro("include")
    )
    out = convert(body)
    assert [(r["ordinal"], r["identity"], r["status"]) for r in out["references"]] == [
        *[(i, str(i), "deferred_mvp") for i in range(1, 7)], (7, "confluence:page:9", "deferred_mvp"), (8, "unknown", "unresolved_target"),
    ]
    assert [(w["code"], w["name"]) for w in out["warnings"]] == [("unsupported_element", "blink"), ("unhandled_macro", "odd"), ("unsupported_element", "wink"), ("unsupported_element", "link"), ("unsupported_element", "page")]
    assert out["counters"] == {"handled:drawio": 1, "handled:include": 1, "unhandled:odd": 1, "toc_dropped": 0, "media_placeholders": 6, "unsupported_elements": 4, "complex_tables": 0}


def test_nested_tables_are_bounded():
    body = "x"
    for _ in range(6):
        body = f"<table><tr><td><p>{body}</p></td></tr></table>"
    assert [w["code"] for w in convert(body)["warnings"]] == ["complex_table_fallback"] + ["complex_table_grid"] * 5


def test_grid_takes_the_first_free_places():
    """Against a plain search over a matrix of taken places."""
    import random

    from tessera.functions.storage import Cell

    rng = random.Random(1)
    for _ in range(300):
        rows = [[Cell("", (str(rng.randint(1, 3)), str(rng.randint(1, 3))), False, []) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        taken, at, ok = {}, {}, True
        for y, row in enumerate(rows):
            for c in row:
                h, w = map(int, c.spans)
                ok &= y + h <= len(rows)
                x = next(x for x in range(100) if not any((y + i, x + j) in taken for i in range(h) for j in range(w)))
                taken.update({(y + i, x + j): c for i in range(h) for j in range(w)})
                at[y, x] = c
        got = grid(rows)
        assert (got is not None) == ok
        if ok:
            assert {(y, x): c for y, r in enumerate(got) for x, c in enumerate(r) if c} == at and len({len(r) for r in got}) == 1


def test_cells_are_escaped_once():
    assert encoded("a|b\\|c\\\\d\\e\nf\\") == "a\\|b\\|c\\\\d\\\\e<br>f\\\\"


def test_very_deep_and_long_pages():
    assert convert("<div>" * 5000 + "x" + "</div>" * 5000)["text"] == "x"
    assert len(convert("<p>word </p>" * 50_000)["text"]) == 50_000 * 6 - 2


def test_pages_as_a_table(spark):
    df = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>"), (3, None), (4, "")], "document_id long, storage string").withColumns({"fault": F.lit("z"), "k": F.lit(1)})
    rows = {r.document_id: r for r in storage_pages(df).collect()}
    assert (rows[1].text, rows[1].fault, rows[1].k) == ("a", None, 1) and rows[2].text is None and "malformed" in rows[2].fault
    assert rows[3].text is None and rows[3].fault is None and rows[4].text == "" and rows[4].references == []
    assert storage_pages(df.limit(0)).collect() == []


def test_hot_targets_and_ambiguous_ones(spark, monkeypatch):
    """A page that all others name, a title of two pages, a file that stands twice, and names of nothing."""
    body = macro("include", "<ri:page ri:content-title='Home'/>") + macro("include", "<ri:page ri:content-title='Two'/>") + "<ac:image><ri:attachment ri:filename='a'/></ac:image><ac:image><ri:attachment ri:filename='b'/></ac:image><a href='/pages/3'>x</a><a href='/pages/3/y'>x</a>"
    pages = storage_pages(spark.createDataFrame([(f"p{i}", body) for i in range(50)], "document_id string, storage string"))
    files = spark.createDataFrame([("p1", "a", "m1"), ("p1", "b", "m2"), ("p1", "b", "m3"), ("p2", "a", "m4")], "document_id string, filename string, media_id string")
    targets = spark.createDataFrame([("Home", "confluence:page:0"), ("Two", "confluence:page:1"), ("Two", "confluence:page:2"), (None, "confluence:page:3")], "title string, target_id string")
    from tessera.functions import joins

    out = relations.reference_relations(pages, files, targets, "now").collect()
    assert len(out) == 50 * 5 and len({r.relation_id for r in out}) == 250
    found = {(r.source_id, r.evidence): r.target_id for r in out if r.resolution_status == "resolved"}
    assert sum(e == "Home" for _, e in found) == 50 and found["p1", "a"] == "m1" and ("p1", "b") not in found and found["p9", "confluence:page:3"] == "confluence:page:3"
    assert all(r.target_id.startswith("confluence:page:unresolved-") for r in out if r.evidence == "Two")
    monkeypatch.setattr(joins, "few", lambda *a: False)
    assert {r.relation_id for r in relations.reference_relations(pages, files, targets, "now").collect()} == {r.relation_id for r in out}


def test_dealt_join_keeps_every_row(spark):
    from tessera.functions.joins import dealt_join

    rows = spark.createDataFrame([(k, i) for i in range(300) for k in ([1] * 5 + [2, None, i + 10])], "k int, i int")
    side = spark.createDataFrame([(1, "a"), (11, "b")], "k int, v string")
    want = sorted((r.k or 0, r.i, r.v or "") for r in rows.join(side, "k", "left").collect())
    assert sorted((r.k or 0, r.i, r.v or "") for r in dealt_join(rows, side, "k", "i", 100).collect()) == want


def test_objects_of_few_pages_at_once(spark, monkeypatch):
    """A batch of Spark's is worked off in parts: a worker holds what it made of a few pages, not of all."""
    import pyarrow as pa

    from tessera.operators import wiki
    from tessera.operators.chunking import Budget

    runs = []
    pages = spark.createDataFrame([("1", "t", "<p>x</p>")], "document_id string, title string, storage string")
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema: (runs.append(f), self)[1])
    storage_pages(pages)
    wiki.chunk_pages(pages, "storage", Budget())
    batch = pa.record_batch([pa.array([str(i) for i in range(300)]), pa.array(["t"] * 300), pa.array(["<p>x</p>"] * 300)], names=pages.columns)
    for run in runs:
        made = list(run(iter([batch, batch.slice(0, 0)])))
        assert max(b.num_rows for b in made) <= 128 and [x for b in made for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(runs) == 2
