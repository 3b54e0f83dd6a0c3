"""The program's tables, bound to the given ones.

A learner is a customer, an attempt an order with its lines, activity and answers are
events, a tutor is a supplier who is assigned the customers of his nation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy readers and bound views over a folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def learners(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("track"), F.col("c_nationkey").alias("grp"))

    @cached_property
    def attempts(self) -> DataFrame:
        """One row for each order with lines; both sides are reduced before they meet."""
        lines = self.read("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").alias("ended"), F.count("*").alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("correct"))
        orders = self.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("started"))
        return orders.join(lines, orders.id == lines.l_orderkey).select(
            "id", "user_id", "kind", "started", "ended", "total", "correct", F.round(100.0 * F.col("correct") / F.col("total")).cast("int").alias("accuracy"),
            (F.datediff("ended", "started").cast("bigint") * 86_400_000).alias("duration_ms"))

    @cached_property
    def activity(self) -> DataFrame:
        return self.read("events").groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))

    @cached_property
    def answers(self) -> DataFrame:
        k = F.from_json("props", "k int")["k"]
        return self.read("events").select("event_id", "user_id", F.col("event_type").alias("skill"), "ts", "value", k.alias("k"), F.coalesce(k % 2 == 0, F.lit(False)).alias("ok"))


#: The same views for DuckDB; only those that a query names are evaluated.
VIEWS = """
learners AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS track, c_nationkey AS grp FROM customer),
attempts AS (
  SELECT id, user_id, kind, started, ended, total, correct, round(100.0 * correct / total)::INT AS accuracy,
         datediff('day', started::DATE, ended::DATE)::BIGINT * 86400000 AS duration_ms
  FROM (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS kind, o_orderdate AS started, max(l_shipdate) AS ended,
               count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS correct
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)),
activity AS (SELECT user_id, ts::DATE AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL),
answers AS (SELECT event_id, user_id, event_type AS skill, ts, value, k, coalesce(k % 2 = 0, false) AS ok FROM (SELECT *, (props->>'k')::INT AS k FROM events)),
srs AS (
  SELECT user_id, skill, count(*) AS seen, count(*) FILTER (ok) AS correct_n, count(*) FILTER (NOT ok) AS wrong_n, max(ts)::DATE AS last_day,
         list_reduce(list_prepend(0, list(ok::INT ORDER BY ts, event_id)), lambda a, x: CASE WHEN a = 0 THEN 3 WHEN x = 1 THEN least(a * 2, 7) ELSE 1 END) AS interval_days
  FROM answers GROUP BY user_id, skill),
as_of AS (SELECT max(ts)::DATE AS today FROM events)
"""
