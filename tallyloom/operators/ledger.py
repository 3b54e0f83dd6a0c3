"""Assertions about whole tables, as rows: sorted, unique, exact set, total.

Each gives its name, its kind, whether it holds, how many rows break it and one of them.
Nothing is gathered: order is checked within runs of rows and then between the runs'
ends, sets and repeats by aggregation before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

RUN = 4096  # rows in a run


def _verdict(broken: DataFrame, name: str, kind: str) -> DataFrame:
    """One row from broken (example): none of them means that the assertion holds."""
    return broken.agg(F.count("*").alias("violations"), F.min(F.col("example").cast("string")).alias("example")).select(
        F.lit(name).alias("name"), F.lit(kind).alias("kind"), (F.col("violations") == 0).alias("holds"), "violations", "example")


def is_sorted(table: DataFrame, key: str, name: str) -> DataFrame:
    """Whether the rows of a parquet table stand in the order of key, file by file; example: the smallest key that comes too late.

    A row's place in its file is read with it; the last row of a run is compared with the
    first of the next one, so borders of partitions don't matter.
    """
    rows = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(key).alias("k"))
    rows = rows.withColumn("run", F.floor(F.col("at") / RUN))
    before = F.lag("k").over(Window.partitionBy("file", "run").orderBy("at"))
    inside = rows.withColumn("before", before).where("k < before").select(F.col("k").alias("example"))
    ends = rows.groupBy("file", "run").agg(F.min_by("k", "at").alias("k"), F.max_by("k", "at").alias("last"))
    border = ends.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("run"))).where("k < before").select(F.col("k").alias("example"))
    return _verdict(inside.union(border), name, "sorted")


def is_unique(table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether no two rows have the same keys; violations: keys that are there more than once."""
    often = table.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _verdict(often.select(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias("example")), name, "unique")


def is_exact_set(table: DataFrame, key: str, wanted: DataFrame, other: str, name: str) -> DataFrame:
    """Whether key takes exactly the values that other has in wanted; violations: those on one side only."""
    a, b = table.select(F.col(key).alias("v")).distinct().withColumn("a", F.lit(1)), wanted.select(F.col(other).alias("v")).distinct().withColumn("b", F.lit(1))
    return _verdict(a.join(b, "v", "full").where("a is null or b is null").select(F.col("v").alias("example")), name, "exact set")


def is_total(table: DataFrame, value: Column, wanted: Column, name: str) -> DataFrame:
    """Whether an aggregate of the table equals another one; example: what it is instead."""
    one = table.agg(value.alias("have"), wanted.alias("want"))
    return _verdict(one.where(~F.col("have").eqNullSafe(F.col("want"))).select(F.col("have").alias("example")), name, "total")


@query("ledger_assertions", """
WITH o AS (SELECT o_orderkey AS k, row_number() OVER () AS pos FROM orders), os AS (SELECT k, lag(k) OVER (ORDER BY pos) AS before FROM o),
c AS (SELECT o_custkey AS k, row_number() OVER () AS pos FROM orders), cs AS (SELECT k, lag(k) OVER (ORDER BY pos) AS before FROM c),
b AS (
  SELECT 'orders by key' AS name, 'sorted' AS kind, count(*) AS violations, min(k::VARCHAR) AS example FROM os WHERE k < before
  UNION ALL SELECT 'orders by learner', 'sorted', count(*), min(k::VARCHAR) FROM cs WHERE k < before
  UNION ALL SELECT 'events', 'unique', count(*), min(k::VARCHAR) FROM (SELECT event_id AS k FROM events GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'lines by order', 'unique', count(*), min(k) FROM (SELECT l_orderkey || ':' || l_linenumber AS k FROM lineitem GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'regions of nations', 'exact set', count(*), min(k::VARCHAR) FROM (SELECT coalesce(n, r) AS k FROM (SELECT DISTINCT n_regionkey AS n FROM nation) FULL JOIN (SELECT r_regionkey AS r FROM region) ON n = r WHERE n IS NULL OR r IS NULL)
  UNION ALL SELECT 'orders with lines', 'exact set', count(*), min(k::VARCHAR) FROM (SELECT coalesce(a, b) AS k FROM (SELECT DISTINCT l_orderkey AS a FROM lineitem) FULL JOIN (SELECT DISTINCT o_orderkey AS b FROM orders) ON a = b WHERE a IS NULL OR b IS NULL)
  UNION ALL SELECT 'letters', 'total', count(*), min(x::VARCHAR) FROM (SELECT sum(n_chars)::BIGINT AS x, sum(length(text))::BIGINT AS y FROM documents) WHERE x IS DISTINCT FROM y
  UNION ALL SELECT 'languages', 'total', count(*), min(x::VARCHAR) FROM (SELECT count(DISTINCT lang) AS x, 5 AS y FROM documents) WHERE x IS DISTINCT FROM y)
SELECT name, kind, violations = 0 AS holds, violations, example FROM b""")
def ledger_assertions(t: Tables) -> DataFrame:
    """Eight assertions about the tables."""
    orders, lines, docs = t.read("orders"), t.read("lineitem"), t.read("documents")
    return reduce(DataFrame.union, [
        is_sorted(orders, "o_orderkey", "orders by key"), is_sorted(orders, "o_custkey", "orders by learner"),
        is_unique(t.read("events"), ["event_id"], "events"), is_unique(lines, ["l_orderkey", "l_linenumber"], "lines by order"),
        is_exact_set(t.read("nation"), "n_regionkey", t.read("region"), "r_regionkey", "regions of nations"), is_exact_set(lines, "l_orderkey", orders, "o_orderkey", "orders with lines"),
        is_total(docs, F.sum("n_chars"), F.sum(F.length("text")), "letters"), is_total(docs, F.count_distinct("lang"), F.lit(5).cast("bigint"), "languages"),
    ])
