"""Sections, fields and lists of pages, as written out by hand; and over all given pages against a plain reading."""

from __future__ import annotations

import html as entities
import random
import re

from pyspark.sql import functions as F

from corvane.sources import page_tree

SF = "/root/testdata/sf0.001"
PAGE = """<html><head><title>T</title></head><body><nav><h3>Menu</h3><p>no</p></nav><div class="sub_content">
<h1>Top</h1><p>lead</p>
<h4 class="tit-h2">Guide</h4><p>one</p><p>two <b>bold</b></p>
<h4>Free</h4><p>under a page title</p>
<h4 class="tit-h3">Leave</h4><span>start</span>
<h2 class="tit-h4">Period</h2><table><tr><th>Kind</th><th>When</th></tr><tr><td>A</td><td>May</td></tr><tr><td>B</td><td></td></tr><tr><td>C</td></tr></table>
<h5>Leave forms</h5><ul><li>x</li><li>y <i>z</i></li></ul>
<p><strong>Lone</strong></p>
<h4>Nothing</h4>
<h3>Other</h3><table><tr><th>Who</th><td>all</td><td>of us</td></tr><tr><th>Who</th><td>me</td></tr><tr><td>loose</td></tr><tr><td></td></tr><tr><td>last</td></tr></table>
<h5>Deep</h5><div>in <p>it</div></div><footer><h3>End</h3><p>no</p></footer></body></html>"""
SECTIONS = [
    (2, "Guide", "one\ntwo bold", []),
    (4, "Free", "under a page title", []),
    (3, "Leave", "start", []),
    (4, "Leave > Period", "", [("Kind", "A"), ("When", "May"), ("Kind_2", "B"), ("Kind_3", "C")]),
    (5, "Leave forms", "Lone", [("항목_1", "x"), ("항목_2", "y z")]),
    (3, "Other", "", [("Who", "all of us / me"), ("내용_1", "loose"), ("내용_3", "last")]),
    (5, "Other > Deep", "in it", []),
]
BOARD = """<div id="x"><table><tbody><tr><td class="td_subject"><a href="/no">wrong table</a></td></tr></tbody></table></div><div class="tbl_wrap"><table><tbody>
<tr><td class="td_num">notice</td><td class="td_subject"><a href="/b?bo_table=n&id=1"> Pinned <b>one</b></a></td><td class="td_date">23-12-01</td></tr>
<tr><td class="td_num">12</td><td class="td_subject"><a href="b?bo_table=n&id=2">New</a></td><td class="td_datetime">2024-03-05</td></tr>
<tr><td class="td_num">11</td><td class="td_subject"><a href="/b?bo_table=other">Elsewhere</a></td></tr><tr><td class="td_num">10</td><td class="td_subject">No link</td></tr>
<tr><td class="td_num">9</td><td class="td_subject"><a href="/b?bo_table=n&id=3">Old</a></td><td class="td_date">2023-11-01</td></tr>
<tr><td class="td_subject"><a href="/b?bo_table=n&id=4">Behind</a></td></tr></tbody></table></div>"""


def test_sections_by_hand(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<title>Plain</title><body><p>a<p>b</body>"), (3, None), (4, ""), (5, "<body><b>not alone</b> text</body>")], "page_id long, html string")
    found: dict = {}
    for r in page_tree.page_sections(pages).orderBy("page_id", "seq").collect():
        found.setdefault(r["page_id"], []).append((r["level"], r["title"], r["text"], [tuple(f) for f in r["fields"]]))
    assert found == {1: SECTIONS, 2: [(None, "Plain", "a\nb", [("내용", "a\nb")])], 5: [(None, "안내", "not alone\ntext", [("내용", "not alone\ntext")])]}
    page_tree.register(spark)
    pages.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT page_id, s.title FROM some_pages, LATERAL page_sections(html) s").count() == 9
    assert [(r["name"], r["value"]) for r in spark.sql("SELECT f.* FROM some_pages, LATERAL page_fields(html) f WHERE page_id = 1 ORDER BY table, seq").collect()] == [*SECTIONS[3][3], *SECTIONS[5][3]]


def test_board_lists_by_hand(spark):
    pages = spark.createDataFrame([(1, BOARD), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    found = page_tree.list_posts(pages, F.lit("2024-02-20").cast("date"), base="http://u/list", board="bo_table=n").orderBy("seq").collect()
    assert [(r["url"], r["title"], str(r["posted"]), r["pinned"]) for r in found] == [("http://u/b?bo_table=n&id=1", "Pinnedone", "2023-12-01", True), ("http://u/b?bo_table=n&id=2", "New", "2024-03-05", False)]


def test_given_pages(spark):
    """The given pages' only headings are bold lines that are all their paragraphs have, beside which nothing stands; others are one section with all their text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = page_tree.page_sections(pages).join(pages, "page_id").collect()
    bold = {r["page_id"] for r in pages.collect() if any(page_tree.is_heading(x) for x in page_tree.tree(r["html"], page_tree.FRAME).elements())}
    assert {r["page_id"] for r in rows} == {r["page_id"] for r in pages.collect()} - bold and 0 < len(bold) < pages.count() / 2
    for r in rows:
        shown = re.sub(r"<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", "", r["html"].split("</head>", 1)[1], flags=re.S)
        plain = re.sub(r"<[^>]*>", "", shown)
        assert r["level"] is None and re.sub(r"\s", "", r["text"]) == re.sub(r"\s", "", entities.unescape(plain))


def _shape(node):
    return [x if isinstance(x, str) else (x.tag, x.attrs, x.place, _shape(x)) for x in node.inside]


def test_plain_pages_are_read_as_by_the_library(monkeypatch):
    """Whatever is read without the library's parser equals what that gives; most of the pages made of plain pieces are."""
    rng, plain = random.Random(5), page_tree._plain
    pieces = ["<p>", "</p>", "<TD Class='a b'>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "<a href=\"/x?a=1&amp;b=2&amp;lt;\" id=''>", "</a>", "<br>", "text ", "\n", "a > b", "<li >", "<ul>", "</ul>", "<h2>", "</h2>"]
    odd = ["&lt;", "&", "<", "<!-- c -->", "<br/>", "<script>", "</script>", "<td nowrap>", "<a href=x>", "</td >", "<title>", "<a b='&copy;'>", "<x-y>", "<p a='1'b='2'>"]
    pages = ["".join(rng.choice(pieces if rng.random() < 0.97 else odd) for _ in range(rng.randrange(40))) for _ in range(3000)] + [BOARD, PAGE]
    read = [page_tree.tree(x) for x in pages]
    monkeypatch.setattr(page_tree, "_plain", lambda _: None)
    assert [_shape(x) for x in read] == [_shape(page_tree.tree(x)) for x in pages]
    assert sum(plain(x) is not None for x in pages) > 1000


def test_lists_are_read_once(spark):
    """A list's stop comes from the rows that are returned, not from a second reading of all pages."""
    pages = spark.createDataFrame([(1, BOARD), (None, BOARD)], "page_id long, html string")
    found = page_tree.list_posts(pages, F.lit("2024-02-20").cast("date"), base="http://u/list", board="bo_table=n")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [r["n"] for r in found.groupBy("page_id").agg(F.count("*").alias("n")).orderBy("page_id").collect()] == [4, 2]
