"""Calendar reports over activity: streaks, recent days, labels, ordered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.calendar import days_since, local_date, next_saturday, relative_label
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables


def today(t: Tables) -> DataFrame:
    """The day of the last event, as one row."""
    return t.read("events").agg(F.to_date(F.max("ts")).alias("today"))


@query("activity_fold", "SELECT user_id, day, kind, n FROM activity")
def activity_fold(t: Tables) -> DataFrame:
    """Daily counters, as upserts would have left them."""
    return t.activity.select("user_id", "day", "kind", "n")


@query("streak", """
WITH d AS (SELECT user_id, day FROM activity UNION SELECT user_id, ended::DATE FROM attempts WHERE ended::DATE <= (SELECT today FROM as_of)),
r AS (SELECT user_id, day, day + row_number() OVER (PARTITION BY user_id ORDER BY day DESC)::INT AS island FROM d),
i AS (SELECT user_id, island, max(day) AS last_day, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT user_id, max((last_day, n)) AS m FROM i GROUP BY user_id)
SELECT user_id, CASE WHEN struct_extract_at(m, 1) >= today - 1 THEN struct_extract_at(m, 2) ELSE 0 END AS streak FROM b, as_of""")
def streak(t: Tables) -> DataFrame:
    """Length of the run of days that ends on the last day or the one before; else 0."""
    day = t.activity.select("user_id", "day")
    last = t.read("lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("day")).crossJoin(F.broadcast(today(t))).where("day <= today").select("l_orderkey", "day")
    ended = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")).join(last, "l_orderkey").select("user_id", "day")
    days = day.union(ended).distinct()
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    islands = days.withColumn("island", F.date_add("day", F.row_number().over(w)))
    runs = islands.groupBy("user_id", "island").agg(F.max("day").alias("last_day"), F.count("*").alias("n"))
    last = runs.groupBy("user_id").agg(F.max(F.struct("last_day", "n")).alias("m")).crossJoin(F.broadcast(today(t)))
    return last.select("user_id", F.when(F.col("m.last_day") >= F.date_sub("today", 1), F.col("m.n")).otherwise(0).alias("streak"))


@query("last7_activity", """
WITH days AS (SELECT unnest(range(7))::INT AS back), u AS (SELECT DISTINCT user_id FROM activity),
g AS (SELECT user_id, today - back AS day FROM u, days, as_of),
n AS (SELECT g.user_id, g.day, coalesce(sum(n), 0)::BIGINT AS n FROM g LEFT JOIN activity a ON a.user_id = g.user_id AND a.day = g.day GROUP BY ALL)
SELECT user_id, list(n ORDER BY day)::VARCHAR AS counts, greatest(max(n), 1) AS top FROM n GROUP BY user_id""")
def last7_activity(t: Tables) -> DataFrame:
    """Counts of the last seven calendar days, oldest first, zeros filled in; and their maximum, 1 at least."""
    recent = t.activity.crossJoin(F.broadcast(today(t)))
    per_day = [F.sum(F.when(F.col("day") == F.date_sub("today", back), F.col("n")).otherwise(0)).alias(f"d{back}") for back in range(6, -1, -1)]
    g = recent.groupBy("user_id").agg(*per_day)
    days = F.array(*(f"d{back}" for back in range(6, -1, -1)))
    return g.select("user_id", F.concat(F.lit("["), F.array_join(days.cast("array<string>"), ", "), F.lit("]")).alias("counts"), F.greatest(F.array_max(days), F.lit(1)).alias("top"))


@query("last7_rows", """
SELECT user_id, min(day) AS from_day, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, kind) AS rn FROM activity) WHERE rn <= 7 GROUP BY user_id""")
def last7_rows(t: Tables) -> DataFrame:
    """The reading by rows: seven counter rows, which may be fewer days."""
    w = Window.partitionBy("user_id").orderBy(F.desc("day"), "kind")
    return t.activity.withColumn("rn", F.row_number().over(w)).where("rn <= 7").groupBy("user_id").agg(F.min("day").alias("from_day"), F.sum("n").alias("n"))


@query("last_active_label", """
WITH l AS (SELECT user_id, max(day) AS last_day FROM activity GROUP BY user_id), d AS (SELECT *, (today + 2 - last_day)::INT AS days FROM l, as_of)
SELECT user_id, last_day, days, CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' ELSE days || ' days ago' END AS label FROM d""")
def last_active_label(t: Tables) -> DataFrame:
    """Last day of activity, and how long ago it is two days after the last event."""
    g = t.activity.groupBy("user_id").agg(F.max("day").alias("last_day")).crossJoin(F.broadcast(today(t)))
    days = days_since(F.date_add("today", 2), F.col("last_day"))
    return g.select("user_id", "last_day", days.alias("days"), relative_label(days).alias("label"))


@query("local_days", """
SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS local_day,
       (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE + (1 + (5 - dayofweek((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE) + 7) % 7)::INT AS saturday FROM events""")
def local_days(t: Tables) -> DataFrame:
    """Day of each event in a time zone, and the Saturday strictly after it."""
    day = local_date(F.col("ts"), "America/New_York")
    return t.read("events").select("event_id", day.alias("local_day"), next_saturday(day).alias("saturday"))


@query("recent_memory", """
SELECT event_id, user_id, coalesce(list_contains(list(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), k), false) AS seen
FROM answers WHERE k IS NOT NULL""")
def recent_memory(t: Tables) -> DataFrame:
    """Whether a learner's last twenty questions had this one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    rows = t.answers.where("k is not null").select("event_id", "user_id", "k", F.collect_list("k").over(w).alias("past"))
    return rows.select("event_id", "user_id", F.array_contains("past", F.col("k")).alias("seen"))


@query("order_check", """
SELECT user_id, id, started, before FROM (SELECT *, lag(ended) OVER (PARTITION BY user_id ORDER BY started, id) AS before FROM attempts) WHERE before > started""")
def order_check(t: Tables) -> DataFrame:
    """Attempts that begin before the learner's previous one has ended."""
    w = Window.partitionBy("user_id").orderBy("started", "id")
    return t.attempts.withColumn("before", F.lag("ended").over(w)).where("before > started").select("user_id", "id", "started", "before")


@query("rounds", """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, turn, (pos // 4)::INT AS part,
       (CASE WHEN pos < (n % ceil(n / 6)) * (floor(n / ceil(n / 6)) + 1) THEN floor(pos / (floor(n / ceil(n / 6)) + 1))
             ELSE (n % ceil(n / 6)) + floor((pos - (n % ceil(n / 6)) * (floor(n / ceil(n / 6)) + 1)) / floor(n / ceil(n / 6))) END)::INT AS round FROM c""")
def rounds(t: Tables) -> DataFrame:
    """Parts of four, and balanced rounds of at most six, of each conversation's turns."""
    w = Window.partitionBy("conv_id")
    c = t.read("conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("turn")) - 1).alias("pos"))
    number = F.ceil(F.col("n") / 6)
    size, more = F.floor(F.col("n") / number), F.col("n") % number
    at = F.when(F.col("pos") < more * (size + 1), F.floor(F.col("pos") / (size + 1))).otherwise(more + F.floor((F.col("pos") - more * (size + 1)) / size))
    return c.select("conv_id", "turn", F.floor(F.col("pos") / 4).cast("int").alias("part"), at.cast("int").alias("round"))


@query("fill_down", """
WITH c AS (SELECT conv_id, turn, role, text, role = 'user' AND turn % 3 <> 1 AS head FROM conversations)
SELECT conv_id, turn, role, last_value(CASE WHEN head THEN turn END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS asked,
       coalesce(first_value(CASE WHEN head THEN turn END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(turn) OVER (PARTITION BY conv_id) + 1) AS block_end
FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def fill_down(t: Tables) -> DataFrame:
    """Each turn with the heading above it, and where its block ends: at the next heading, else after the last turn."""
    whole = Window.partitionBy("conv_id")
    w = whole.orderBy("turn", "role", "text")
    c = t.read("conversations").withColumn("head", F.when((F.col("role") == "user") & (F.col("turn") % 3 != 1), F.col("turn")))
    below = F.first("head", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return c.select("conv_id", "turn", "role", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("asked"), F.coalesce(below, F.max("turn").over(whole) + 1).alias("block_end"))
