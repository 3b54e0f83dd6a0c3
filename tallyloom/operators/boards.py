"""Leaderboards and other top-k reports. Every order ends with an id, so ties are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

TIMED, FLAT, TUTOR = "1-URGENT", "2-HIGH", 1


@query("board_timed", f"""
SELECT a.id AS id, name, correct, accuracy, total FROM attempts a JOIN learners l ON l.id = a.user_id
WHERE kind = '{TIMED}' ORDER BY correct DESC, accuracy DESC, a.id LIMIT 20""")
def board_timed(t: Tables) -> DataFrame:
    """Best timed attempts with the learner's name (a learner may appear more than once)."""
    timed = t.attempts.where(F.col("kind") == TIMED)
    joined = timed.join(t.learners.select(F.col("id").alias("user_id"), "name"), "user_id")
    return joined.orderBy(F.desc("correct"), F.desc("accuracy"), "id").limit(20).select("id", "name", "correct", "accuracy", "total")


@query("board_flat", f"""
WITH done AS (SELECT * FROM attempts WHERE kind = '{FLAT}' AND ended > started),
p AS (SELECT 0 AS branch, row_number() OVER (ORDER BY duration_ms, id) AS rank, * FROM done WHERE total = correct),
q AS (SELECT 1 AS branch, row_number() OVER (ORDER BY correct DESC, duration_ms, id) AS rank, * FROM done WHERE total > correct),
u AS (SELECT * FROM p WHERE rank <= 20 UNION ALL SELECT * FROM q WHERE rank <= 20)
SELECT branch, rank, u.id AS id, name, correct, total, duration_ms FROM u JOIN learners l ON l.id = u.user_id ORDER BY branch, rank LIMIT 20""")
def board_flat(t: Tables) -> DataFrame:
    """Perfect attempts by speed, then imperfect ones by score and speed; twenty in all."""
    done = t.attempts.where((F.col("kind") == FLAT) & (F.col("ended") > F.col("started")))
    done = done.withColumns({"branch": F.when(F.col("total") == F.col("correct"), 0).otherwise(1), "missing": F.when(F.col("total") == F.col("correct"), 0).otherwise(-F.col("correct"))})
    # one pass: both branches have one order, and each task keeps its first twenty of either
    w = Window.partitionBy("branch").orderBy("missing", "duration_ms", "id")
    top = done.where("total >= correct").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20")
    joined = top.join(t.learners.select(F.col("id").alias("user_id"), "name"), "user_id")
    return joined.orderBy("branch", "rank").limit(20).select("branch", "rank", "id", "name", "correct", "total", "duration_ms")


@query("board_top5_by_type", """
SELECT kind, rank, a.id AS id, name, correct, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY correct DESC, accuracy DESC, id) AS rank FROM attempts) a
JOIN learners l ON l.id = a.user_id WHERE rank <= 5""")
def board_top5_by_type(t: Tables) -> DataFrame:
    """Five best attempts of each kind. Each task first keeps its own five of a kind."""
    w = Window.partitionBy("kind").orderBy(F.desc("correct"), F.desc("accuracy"), "id")
    top = t.attempts.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")
    return top.join(t.learners.select(F.col("id").alias("user_id"), "name"), "user_id").select("kind", "rank", "id", "name", "correct", "accuracy")


@query("board_assigned", f"""
SELECT a.id AS id, name, correct, duration_ms FROM attempts a JOIN learners l ON l.id = a.user_id
WHERE ended > started AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = {TUTOR} AND s_nationkey = l.grp)
ORDER BY correct DESC, duration_ms, a.id LIMIT 5""")
def board_assigned(t: Tables) -> DataFrame:
    """Best attempts of one tutor's learners, through a semi-join."""
    tutor = t.read("supplier").where(F.col("s_suppkey") == TUTOR).select(F.col("s_nationkey").alias("grp"))
    mine = t.learners.join(tutor, "grp", "left_semi").select(F.col("id").alias("user_id"), "name")
    order = (F.desc("correct"), F.asc("duration_ms"), F.asc("id"))
    return t.attempts.where("ended > started").join(mine, "user_id").orderBy(*order).limit(5).select("id", "name", "correct", "duration_ms")


@query("notes_recent", """
SELECT o_orderkey AS id, c_name AS author, o_orderdate AS created FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def notes_recent(t: Tables) -> DataFrame:
    """The newest twenty with their author."""
    notes = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("created"))
    joined = notes.join(t.read("customer").select("c_custkey", F.col("c_name").alias("author")), "c_custkey")
    return joined.orderBy(F.desc("created"), "id").limit(20).select("id", "author", "created")


@query("newest_reusable", """
SELECT user_id, kind, arg_max(id, (started, id)) AS id, max(started) AS started FROM attempts WHERE correct < total GROUP BY user_id, kind""")
def newest_reusable(t: Tables) -> DataFrame:
    """For each learner and kind the newest unfinished attempt."""
    newest = F.max(F.struct("started", "id"))
    return t.attempts.where("correct < total").groupBy("user_id", "kind").agg(newest.alias("n")).select("user_id", "kind", "n.id", "n.started")


@query("latest_per_learner", """
SELECT user_id, id, started FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, id) AS rn FROM attempts) WHERE rn <= 10""")
def latest_per_learner(t: Tables) -> DataFrame:
    """The latest ten attempts of each learner."""
    w = Window.partitionBy("user_id").orderBy(F.desc("started"), "id")
    return t.attempts.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 10").select("user_id", "id", "started")
