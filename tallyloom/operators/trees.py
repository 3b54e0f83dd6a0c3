"""Trees from streams of tags: numbered nodes, and what a node inherits from its nearest ancestor.

A page becomes a row for each element: its number in document order, the last number
within it, its depth, its own text and its links. Inheritance is then a window: in
document order, the ancestor of a node at depth k is the last node of depth k before it,
so one running "last" for each depth gives all ancestors' values, and the deepest one that
has a value is the nearest. Work grows with nodes times depth; no node meets another one.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.groups import fold_groups
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

#: Fixed values of HTML: elements without an end tag, and those that a next one of the named kinds ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": set("p ul ol div article section nav h1 h2 h3 table footer".split()), "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that keep an open one of ENDED_BY from being ended by what stands in them.
HOLDS = frozenset("ul ol dl table div article section nav body".split())

NODES = "page_id bigint, node int, last int, depth int, tag string, lang string, text string, links array<struct<href:string,text:string>>"


class TagStream(HTMLParser):
    """Numbers the elements of one page: rows of (last, depth, tag, lang, text parts, links), in document order.

    Ends that are missing are put in where HTML has them; ends without a beginning are left
    out; what is open at the end of the page ends there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        for k in range(len(self.open) - 1, -1, -1):
            other = self.rows[self.open[k]][2]
            if tag in ENDED_BY.get(other, ()):
                self.close(k)
                break
            if other in HOLDS:
                break
        attrs = dict(attrs)
        if tag == "a":
            self.end_link()
            self.link = (attrs.get("href") or "").strip(), []
        self.rows.append([len(self.rows), len(self.open), tag, attrs.get("lang"), [], []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        if tag == "a":
            self.end_link()
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][2] == tag:
                self.close(k)
                return

    def handle_data(self, data):
        if self.link is not None:
            self.link[1].append(data)
        elif self.open:
            self.rows[self.open[-1]][4].append(data)

    def end_link(self):
        if self.link is not None and self.open:
            self.rows[self.open[-1]][5].append({"href": self.link[0], "text": " ".join("".join(self.link[1]).split())})
        self.link = None

    def close(self, k: int):
        for node in self.open[k:]:
            self.rows[node][0] = len(self.rows) - 1
        del self.open[k:]


def tag_rows(html: str) -> list[tuple]:
    """(node, last, depth, tag, lang, text, links) of each element."""
    stream = TagStream()
    stream.feed(html)
    stream.end_link()
    stream.close(0)
    return [(node, last, depth, tag, lang, " ".join(" ".join(text).split()), links) for node, (last, depth, tag, lang, text, links) in enumerate(stream.rows)]


def page_nodes(pages: DataFrame) -> DataFrame:
    """A row for each element of pages (page_id, html); see NODES. Text is the element's own, without that of links and inner elements."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = [(page, *r) for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in tag_rows(html)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in NODES.split(", ")])

    return pages.select(F.col("page_id").cast("bigint"), F.coalesce("html", F.lit(""))).mapInArrow(run, NODES)


DEEP = 64


def inherited(nodes: DataFrame, values: dict[str, Column], tree: str = "page_id", order: str = "node", depth: str = "depth") -> DataFrame:
    """nodes with columns of the names in values: the value of the node itself, or of its nearest ancestor that has one.

    A plan holds a window expression for each depth; where there are trees deeper than DEEP
    (pages that never close their tags), they are walked in order instead, one at a time.
    """
    deepest = nodes.agg(F.max(depth)).first()[0] or 0
    if deepest > DEEP:
        own = nodes.withColumns({f"_own_{name}": value for name, value in values.items()})
        columns, names = nodes.columns, list(values)
        kinds = [*((c, nodes.schema[c].dataType) for c in nodes.columns), *((name, own.schema[f"_own_{name}"].dataType) for name in values)]

        def walk(rows: list[dict]) -> list[tuple]:
            near: list[dict] = []  # for each depth on the way to the node, what a node there has or inherits
            out = []
            for r in rows:
                del near[r[depth] :]
                above = near[-1] if near else {}
                near.append({name: above.get(name) if r[f"_own_{name}"] is None else r[f"_own_{name}"] for name in names})
                out.append((*(r[c] for c in columns), *near[-1].values()))
            return out

        return fold_groups(own, [tree], [order], walk, ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in kinds))
    so_far = Window.partitionBy(tree).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.withColumns({f"_own_{name}": value for name, value in values.items()})
    out = own
    for name in values:
        held = F.struct(F.col(f"_own_{name}").alias("v"))  # a node without a value hides that of an earlier one at its depth
        by_depth = [F.last(F.when(F.col(depth) == k, held), ignorenulls=True).over(so_far) for k in range(deepest + 1)]
        out = out.withColumn(f"_all_{name}", F.array(*by_depth))
    # deeper than the node itself there are only nodes of other branches
    nearest = {name: F.get(F.filter(F.reverse(F.transform(F.slice(f"_all_{name}", 1, F.col(depth) + 1), lambda h: h["v"])), lambda v: v.isNotNull()), F.lit(0)) for name in values}
    return out.withColumns(nearest).select(*nodes.columns, *values)


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href as seen from base, by the rules of RFC 3986 (.., query only, fragment only); null where either is no address."""

    def join(b, h):
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([None if b is None or h is None else join(b, h) for b, h in zip(base, href)], dtype=object)


YEAR, GRADE = r"\b(20[0-9]{2})\b", r"(?i)\b(?:grade|g)[ _-]?([3-8])\b"


def found(text: Column, pattern: str) -> Column:
    """The first group of a pattern's first match as a number; null if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1).try_cast("int")


def link_context(pages: DataFrame) -> DataFrame:
    """Each link of pages (page_id, url, html) with what it inherits from the elements around it.

    page_id, node, depth, tag, href, address, label; lang and region (the nearest element
    that has a language, or is an article, a list, a heading and so on); year and grade of
    the nearest element whose own text has one, else of the link's own text, else of its
    address.
    """
    region = F.when(F.col("tag").isin("nav", "article", "section", "footer", "ul", "ol", "table"), F.col("tag"))
    text = F.col("text")
    around = inherited(page_nodes(pages), {"in_lang": F.col("lang"), "region": region, "in_year": found(text, YEAR), "in_grade": found(text, GRADE)})
    links = around.where(F.size("links") > 0).select("page_id", "node", "depth", "tag", F.col("in_lang").alias("lang"), "region", "in_year", "in_grade", F.posexplode("links").alias("place", "link"))
    links = links.join(pages.select("page_id", "url"), "page_id").withColumn("address", joined_url(F.col("url"), F.col("link.href")))
    label, href = F.col("link.text"), F.col("link.href")
    return links.select(
        "page_id", "node", "place", "depth", "tag", href.alias("href"), "address", label.alias("label"), "lang", "region",
        F.coalesce("in_year", found(label, YEAR), found(href, YEAR)).alias("year"), F.coalesce("in_grade", found(label, GRADE), found(href, GRADE)).alias("grade"))


@query("link_context")
def link_contexts(t: Tables) -> DataFrame:
    """Every link of every page with the language, region, year and grade that it inherits."""
    return link_context(t.read("pages").select("page_id", "url", "html"))


@query("page_trees")
def page_trees(t: Tables) -> DataFrame:
    """The shape of each page: elements, depth, list items and the deepest list, and whether numbers nest as intervals must."""
    n = page_nodes(t.read("pages"))
    lists = n.withColumn("inner", F.col("tag").isin("ul", "ol"))
    return lists.groupBy("page_id").agg(
        F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.col("tag") == "li").alias("items"), F.max(F.when(F.col("inner"), F.col("depth"))).alias("deepest_list"), F.sum(F.col("last") - F.col("node")).cast("bigint").alias("inside"),
        F.sum("depth").cast("bigint").alias("depths"))

