"""Trees of pages and what their nodes inherit, against walks with parents."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import trees
from tallyloom.plans import catalog

D = "/root/testdata/sf0.001"
NESTED = """<html lang="en"><body><ul>
<li>2024 tests<ul><li>Grade 3 <a href="g3.pdf">Released questions</a></li>
  <li>Grade 4<ul><li><a href="../x/g4.pdf">Item map</a><li>2023 (late) <a href="?late=1">late</a></ul></li></ul>
<li>No year <a href="#top">Grade 8 guide</a></li>
</ul><p>Grade 5 <p>other <a href="http://h.org/2019/grade-6.pdf">a <b>bold</b> one</a></body></html>"""


def links(spark, *pages):
    df = spark.createDataFrame([(i, "http://a.org/b/c.html", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [(r["address"], r["label"], r["lang"], r["region"], r["year"], r["grade"]) for r in trees.link_context(df).orderBy("page_id", "node", "place").collect()]


def test_nested_lists(spark):
    assert links(spark, NESTED) == [
        ("http://a.org/b/g3.pdf", "Released questions", "en", "ul", 2024, 3),
        ("http://a.org/x/g4.pdf", "Item map", "en", "ul", 2024, 4),
        ("http://a.org/b/c.html?late=1", "late", "en", "ul", 2023, 4),
        ("http://a.org/b/c.html#top", "Grade 8 guide", "en", "ul", None, 8),
        ("http://h.org/2019/grade-6.pdf", "a bold one", "en", None, 2019, 6),
    ]


def test_odd_pages(spark):
    assert links(spark, None, "", "no tags", "</p></ul>", "<a href='x'>open", "<a href=x>1<a href=y>2</a>") == [
        ("http://a.org/b/x", "open", None, None, None, None), ("http://a.org/b/x", "1", None, None, None, None), ("http://a.org/b/y", "2", None, None, None, None)]


def test_missing_ends():
    rows = {(r[3], r[0]): r for r in trees.tag_rows("<ul><li>a<li>b<ul><li>c</ul>d<p>e<p>f</ul><br>g")}
    assert [(tag, node, r[1], r[2], r[5]) for (tag, node), r in rows.items()] == [
        ("ul", 0, 6, 0, ""), ("li", 1, 1, 1, "a"), ("li", 2, 6, 1, "b d"), ("ul", 3, 4, 2, ""), ("li", 4, 4, 3, "c"), ("p", 5, 5, 2, "e"), ("p", 6, 6, 2, "f"), ("br", 7, 7, 0, "")]


@pytest.mark.parametrize("seed", range(3))
def test_inherited_like_a_walk(spark, seed):
    """Random forests: the nearest ancestor with a value is found through parents."""
    r = random.Random(seed)
    rows, want = [], {}
    for page in range(30):
        path = []
        for node in range(r.randrange(1, 40)):
            depth = r.randrange(0, len(path) + 1)
            path = path[:depth] + [r.choice([None, None, node])]
            rows.append((page, node, depth, path[-1]))
            want[page, node] = next((v for v in reversed(path) if v is not None), None)
    got = trees.inherited(spark.createDataFrame(rows, "page_id int, node int, depth int, own int"), {"near": F.col("own")})
    assert {(x["page_id"], x["node"]): x["near"] for x in got.collect()} == want


def test_pages_that_never_close(spark):
    """Trees deeper than a plan may be give the same as shallow ones."""
    deep = "<b>" * 300 + "2021 <a href='x'>one</a>" + "<b>" * 20 + "<a href='y'>two</a>"
    assert [r[4] for r in links(spark, deep, NESTED)] == [2021, 2021, 2024, 2024, 2023, None, 2019]
    assert links(spark, deep, NESTED)[2:] == links(spark, NESTED)


def brute(html):
    """(href, label, region) of each link, by a stack of open elements kept as parents."""
    parent, out, stack = {}, [], []
    for node, last, depth, tag, lang, text, found in trees.tag_rows(html):
        while stack and stack[-1][1] < node:
            stack.pop()
        assert len(stack) == depth and (not stack or last <= stack[-1][1])
        stack.append((node, last, tag, lang))
        region = next((t for *_, t, _ in reversed(stack) if t in ("nav", "article", "section", "footer", "ul", "ol", "table")), None)
        out += [(node, x["href"], x["text"], next((v for *_, v in reversed(stack) if v), None), region) for x in found]
    return out


def test_links_on_the_tables(spark):
    want = [(r["page_id"], *x) for r in pq.read_table(f"{D}/pages.parquet").to_pylist() for x in brute(r["html"] or "")]
    got = catalog.QUERIES["link_context"](spark, D).collect()
    assert sorted((r["page_id"], r["node"], r["href"], r["label"], r["lang"], r["region"]) for r in got) == sorted(want) and len(want) > 100


def test_shapes_on_the_tables(spark):
    got = {r["page_id"]: r.asDict() for r in catalog.QUERIES["page_trees"](spark, D).collect()}
    for r in pq.read_table(f"{D}/pages.parquet").to_pylist():
        rows = trees.tag_rows(r["html"] or "")
        assert got[r["page_id"]]["items"] == (r["html"] or "").count("<li") and got[r["page_id"]]["inside"] == got[r["page_id"]]["depths"] == sum(x[2] for x in rows)
