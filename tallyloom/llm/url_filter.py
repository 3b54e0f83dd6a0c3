"""URL filtering: prefix rules first, link-graph propagation for the rest.

Only DataFrame functions are used. Rules are ``host/path`` prefixes. A url without a
fitting rule takes its host's verdict, which comes from two propagations over the
host graph of the pages' links:

* trust: personalised PageRank along links, restarting at hosts of allowed pages;
* distrust: the same against the direction of links, restarting at hosts of blocked
  pages (who links to blocked hosts is suspect).

Both are probability distributions over hosts. A host is blocked where its distrust
exceeds its trust by more than the part ``settled`` of their sum, so that the size of the
corpus doesn't matter; without evidence it is allowed. Ranks are carried on until no
host's rank changes by more than a part that goes with ``settled``. The SQL stops after
ROUNDS and has an absolute MARGIN; it gives the same rows where no link goes to another
host, as in the given tables.

Defined results: null urls, and urls without ``://``, have an empty host and path, fit
no rule and are allowed; null html has no links; repeated rows are each judged; an
empty table gives an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import join_keys, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host/path)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING, SETTLED = 0.85, 1e-6
ROUNDS, MARGIN = 8, 1e-9  # of the SQL


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], value) -> Column:
    """value(verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(value(verdict, rule))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: links between different hosts, counted before the shuffle."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), 1))
    link = pages.select(host_of(F.col("url")).alias("src"), href.alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href")))
    return link.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, settled: float) -> DataFrame:
    """host, rank: rank restarts at seeds (host, weight summing to 1) and follows src to dst.

    What the seeds hand on is summed up round by round, and divided by its total at the
    end: what left through no link restarts at the seeds in proportion. A round changes
    no host by a larger part than the round before did, as a host passes on what it got in
    the proportions of what it has; the rest to come is about damping / (1 - damping)
    times the last change.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "share")
    moved = materialize(seeds.select("host", F.col("weight").alias("in")), "moved")
    rank = moved.withColumnRenamed("in", "rank")
    while True:
        moved = moved.join(share, F.col("host") == F.col("src")).groupBy("dst").agg((damping * F.sum(F.col("in") * F.col("share"))).alias("in"))
        moved = materialize(moved.where(F.col("in") > 0).withColumnRenamed("dst", "host"), "moved")
        rank = rank.select("host", "rank", F.lit(0.0).alias("in")).union(moved.select("host", F.col("in").alias("rank"), "in"))
        rank = materialize(rank.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("in").alias("in")), "rank")
        change = rank.agg(F.max(F.col("in") / F.col("rank"))).first()[0] or 0.0
        rank = rank.select("host", "rank")
        if change <= settled * (1 - damping):
            total = rank.agg(F.sum("rank").alias("total"))
            return rank.crossJoin(F.broadcast(total)).select("host", (F.col("rank") / F.col("total")).alias("rank"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """page_id, host, path, rule, verdict, by (rule or graph) for every row of pages (page_id, url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumns({
        "rule": rule_of(F.col("host"), F.col("path"), rules, lambda v, r: r),
        "ruled": rule_of(F.col("host"), F.col("path"), rules, lambda v, r: v),
    })
    votes = judged.groupBy("host").agg(F.count_if((F.col("ruled") == "allow") & (F.col("host") != "")).alias("allow"), F.count_if((F.col("ruled") == "block") & (F.col("host") != "")).alias("block"), F.count("*").alias("pages"))
    votes = materialize(votes, "votes")
    edges = materialize(host_edges(pages), "hosts")
    linked = not edges.isEmpty()
    ranks = votes.select("host", "pages")
    for name, vote, turned in (("trust", "allow", edges), ("distrust", "block", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))):
        total = votes.agg(F.sum(vote).alias("total"))
        seeds = votes.where(F.col(vote) > 0).crossJoin(F.broadcast(total)).select("host", (F.col(vote) / F.col("total")).alias("weight"))
        rank = propagate(turned, seeds, damping, settled) if linked else seeds.withColumnRenamed("weight", "rank")  # no links: all rank restarts
        ranks = ranks.join(rank.withColumnRenamed("rank", name), "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    bad = (F.col("host") != "") & (distrust - trust > settled * (distrust + trust))
    ranks = materialize(ranks.select("host", "pages", F.when(bad, "block").otherwise("allow").alias("graph")), "verdicts")
    return join_keys(judged, ranks, ["host"], "pages").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "graph").alias("verdict"), F.when(F.col("ruled").isNull(), "graph").otherwise("rule").alias("by")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def oracle(rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, margin: float = MARGIN) -> str:
    def low(x):
        return f"translate({x}, '{UPPER}', '{LOWER}')"

    def chosen(value):
        cases = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{value(v, r)}'"
            for v, r in sorted(rules, key=lambda r: -len(r[1])) for h, _, p in [r.partition("/")]
        )
        return f"CASE {cases} END"

    steps = []
    for name, vote, a, b in (("trust", "allow_n", "src", "dst"), ("distrust", "block_n", "dst", "src")):
        steps += [
            f"{name}_share AS (SELECT {a} AS a, {b} AS b, links / sum(links) OVER (PARTITION BY {a}) AS share FROM edges)",
            f"{name}_seed AS (SELECT host, {vote} / (SELECT sum({vote}) FROM votes) AS weight FROM votes WHERE {vote} > 0)",
            f"{name}_0 AS (SELECT host, weight AS r FROM {name}_seed)",
        ]
        for i in range(rounds):
            steps += [
                f"{name}_in{i} AS (SELECT b AS host, {damping} * sum(r * share) AS r FROM {name}_{i} JOIN {name}_share ON host = a GROUP BY b)",
                f"{name}_{i + 1} AS (SELECT host, sum(r) AS r FROM (SELECT host, weight * (1 - coalesce((SELECT sum(r) FROM {name}_in{i}), 0)) AS r FROM {name}_seed UNION ALL SELECT host, r FROM {name}_in{i}) GROUP BY host)",
            ]
    href = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\s>]+)"
    return f"""
WITH judged AS (
  SELECT page_id, coalesce({low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {chosen(lambda v, r: r)} AS rule, {chosen(lambda v, r: v)} AS v FROM judged),
votes AS (SELECT host, count(*) FILTER (v = 'allow') AS allow_n, count(*) FILTER (v = 'block') AS block_n FROM ruled WHERE host <> '' GROUP BY host),
hrefs AS (SELECT {low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS href FROM pages),
links AS (SELECT src, {low("regexp_extract(CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END, '(?s)^.*?://([^/?#]*)', 1)")} AS dst FROM hrefs),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
{", ".join(steps)}
SELECT page_id, ruled.host AS host, path, rule,
       coalesce(v, CASE WHEN coalesce(d.r, 0) - coalesce(t.r, 0) > {margin} AND votes.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN v IS NULL THEN 'graph' ELSE 'rule' END AS "by"
FROM ruled LEFT JOIN votes USING (host) LEFT JOIN trust_{rounds} t USING (host) LEFT JOIN distrust_{rounds} d USING (host)"""


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": oracle()}
