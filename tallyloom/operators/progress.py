"""Folds over answers and attempts: spaced repetition, mastery, best scores, grading.

Folds that depend on order are taken apart so that no learner's whole history meets in
one array: the repetition interval needs only what follows the last wrong answer, and
clamped sums compose, so days are folded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

CAP, FIRST = 7, 3
GAIN, LOSS, TOP = 7, -12, 100  # hundredths of mastery


def srs(t: Tables) -> DataFrame:
    """user_id, skill, seen, correct_n, wrong_n, last_day, interval_days.

    The first answer sets the interval to 3; a right one doubles it, to 7 at most; a wrong
    one sets it to 1. So only the answers after the last wrong one count, or all if none
    but the first is wrong.
    """
    key = ["user_id", "skill"]
    at = F.struct("ts", "event_id")
    rows = t.answers.select(*key, "ts", "ok", at.alias("at"))
    ends = rows.groupBy(*key).agg(
        F.count("*").alias("seen"), F.count_if("ok").alias("correct_n"), F.count_if(~F.col("ok")).alias("wrong_n"), F.to_date(F.max("ts")).alias("last_day"),
        F.min("at").alias("first"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("wrong"))
    ends = ends.withColumn("wrong", F.when(F.col("wrong") > F.col("first"), F.col("wrong")))
    after = rows.join(ends.select(*key, "wrong"), key).groupBy(*key).agg(F.count_if(F.col("wrong").isNull() | (F.col("at") > F.col("wrong"))).alias("after"))
    out = ends.join(after, key)
    doubled = F.when(F.col("wrong").isNull(), FIRST * F.pow(F.lit(2.0), F.least(F.col("after") - 1, F.lit(8)))).otherwise(F.pow(F.lit(2.0), F.least(F.col("after"), F.lit(8))))
    return out.select(*key, "seen", "correct_n", "wrong_n", "last_day", F.least(doubled, F.lit(float(CAP))).cast("int").alias("interval_days"))


@query("srs_fold", "SELECT user_id, skill, seen, correct_n, wrong_n, last_day, interval_days, last_day + interval_days AS next_day FROM srs")
def srs_fold(t: Tables) -> DataFrame:
    """State of every reviewed skill, with the day it is due next."""
    return srs(t).withColumn("next_day", F.expr("date_add(last_day, interval_days)"))


DUE = "WITH due AS (SELECT *, last_day + interval_days AS next_day FROM srs, as_of WHERE last_day + interval_days <= today + 2)"
KNOWN = ("click", "purchase", "view")


def due(t: Tables) -> DataFrame:
    """Skills due two days after the last event day (a parameter of the data, never the clock)."""
    today = t.read("events").agg(F.to_date(F.max("ts")).alias("today"))
    rows = srs(t).withColumn("next_day", F.expr("date_add(last_day, interval_days)")).crossJoin(F.broadcast(today))
    return rows.where("next_day <= date_add(today, 2)")


@query("due_queue_prelimit", f"""{DUE},
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_day, skill) AS pos FROM due)
SELECT user_id, skill, next_day, pos FROM q WHERE pos <= 3 AND skill IN {KNOWN}""")
def due_queue_prelimit(t: Tables) -> DataFrame:
    """Three due skills of each learner, then those with known content: may be fewer."""
    w = Window.partitionBy("user_id").orderBy("next_day", "skill")
    return due(t).withColumn("pos", F.row_number().over(w).cast("bigint")).where("pos <= 3").where(F.col("skill").isin(*KNOWN)).select("user_id", "skill", "next_day", "pos")


@query("due_queue_postfilter", f"""{DUE},
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_day, skill) AS pos FROM due WHERE skill IN {KNOWN})
SELECT user_id, skill, next_day, pos FROM q WHERE pos <= 3""")
def due_queue_postfilter(t: Tables) -> DataFrame:
    """Due skills with known content, then three of each learner."""
    w = Window.partitionBy("user_id").orderBy("next_day", "skill")
    return due(t).where(F.col("skill").isin(*KNOWN)).withColumn("pos", F.row_number().over(w).cast("bigint")).where("pos <= 3").select("user_id", "skill", "next_day", "pos")


@query("due_counts", f"""{DUE} SELECT skill, count(*) AS due, count(*) FILTER (wrong_n > correct_n) AS weak FROM due GROUP BY skill""")
def due_counts(t: Tables) -> DataFrame:
    return due(t).groupBy("skill").agg(F.count("*").alias("due"), F.count_if(F.col("wrong_n") > F.col("correct_n")).alias("weak"))


def clamped(steps: Column) -> Column:
    """A sequence of clamped steps as one function x -> least(high, greatest(low, x + add))."""
    zero = F.struct(F.lit(0).alias("add"), F.lit(0).alias("low"), F.lit(TOP).alias("high"))

    def step(f, d):
        return F.struct(
            (f["add"] + d).alias("add"),
            F.greatest(F.lit(0), F.least(F.lit(TOP), f["low"] + d)).alias("low"),
            F.greatest(F.lit(0), F.least(F.lit(TOP), f["high"] + d)).alias("high"))

    return F.aggregate(steps, zero, step)


@query("mastery_fold", f"""
SELECT user_id, skill, list_reduce(list_prepend(0, list(CASE WHEN ok THEN {GAIN} ELSE {LOSS} END ORDER BY ts, event_id)),
       lambda a, x: greatest(0, least({TOP}, a + x))) / 100.0::DOUBLE AS mastery FROM answers GROUP BY user_id, skill""")
def mastery_fold(t: Tables) -> DataFrame:
    """Mastery from 0 to 1 in order of answers; each day becomes one clamped step first."""
    day = t.answers.groupBy("user_id", "skill", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "ok"))).alias("rows"))
    day = day.select("user_id", "skill", "day", clamped(F.transform("rows", lambda r: F.when(r["ok"], GAIN).otherwise(LOSS))).alias("f"))
    days = day.groupBy("user_id", "skill").agg(F.sort_array(F.collect_list(F.struct("day", "f"))).alias("days"))
    total = F.aggregate("days", F.lit(0), lambda x, d: F.least(d["f"]["high"], F.greatest(d["f"]["low"], x + d["f"]["add"])))
    return days.select("user_id", "skill", (total / 100.0).alias("mastery"))


@query("diagnostic_level", """
WITH pos AS (SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS pos FROM (SELECT DISTINCT skill FROM answers)),
g AS (SELECT user_id, skill, count(*) FILTER (k % 3 <> 0) / count(*) >= 0.62 AS pass FROM answers GROUP BY user_id, skill),
u AS (SELECT DISTINCT user_id FROM answers),
r AS (SELECT u.user_id, pos, min(coalesce(pass, false)::INT) OVER (PARTITION BY u.user_id ORDER BY pos) AS run FROM u CROSS JOIN pos LEFT JOIN g ON g.user_id = u.user_id AND g.skill = pos.skill)
SELECT user_id, coalesce(max(pos) FILTER (run = 1), 0)::INT AS level FROM r GROUP BY user_id""")
def diagnostic_level(t: Tables) -> DataFrame:
    """The last skill, in a fixed order, up to which every one is passed; else the first.

    Skills are few and fixed; learners are grouped once and their skills held as a map.
    """
    skills = t.answers.select("skill").distinct().agg(F.sort_array(F.collect_set("skill")).alias("order"))
    g = t.answers.groupBy("user_id", "skill").agg((F.count_if(F.col("k") % 3 != 0) / F.count("*") >= 0.62).alias("pass"))
    passed = g.groupBy("user_id").agg(F.collect_set(F.when(F.col("pass"), F.col("skill"))).alias("passed")).crossJoin(F.broadcast(skills))
    failed = F.array_position(F.transform("order", lambda s: F.array_contains("passed", s)), F.lit(False))
    run = F.when(failed == 0, F.size("order")).otherwise(failed - 1)
    return passed.select("user_id", F.greatest(run - 1, F.lit(0)).cast("int").alias("level"))


@query("section_best", """
SELECT user_id, kind, count(*) AS attempts, arg_max(correct, (correct / total, -epoch(started), -id)) AS best_points, arg_max(total, (correct / total, -epoch(started), -id)) AS best_possible,
       arg_max(correct, (started, id)) AS latest_points, arg_max(total, (started, id)) AS latest_possible, min(started) AS completed,
       round(100.0 * arg_max(correct, (correct / total, -epoch(started), -id)) / arg_max(total, (correct / total, -epoch(started), -id)))::INT AS best_percent
FROM attempts WHERE total > 0 GROUP BY user_id, kind""")
def section_best(t: Tables) -> DataFrame:
    """Attempts, the earliest best by ratio, the latest, and the first completion of each learner and kind."""
    pair = F.struct("correct", "total")
    best = F.max_by(pair, F.struct(F.col("correct") / F.col("total"), -F.unix_seconds(F.col("started").cast("timestamp")), -F.col("id")))
    g = t.attempts.where("total > 0").groupBy("user_id", "kind").agg(
        F.count("*").alias("attempts"), best.alias("b"), F.max_by(pair, F.struct("started", "id")).alias("l"), F.min("started").alias("completed"))
    return g.select("user_id", "kind", "attempts", F.col("b.correct").alias("best_points"), F.col("b.total").alias("best_possible"), F.col("l.correct").alias("latest_points"),
                    F.col("l.total").alias("latest_possible"), "completed", F.round(100.0 * F.col("b.correct") / F.col("b.total")).cast("int").alias("best_percent"))


def _scores(t: Tables, pick) -> DataFrame:
    one = t.answers.where("k is not null").groupBy("user_id", "skill", "k").agg(pick(F.col("value") >= 10, F.struct("ts", "event_id")).alias("right"))
    return one.groupBy("user_id", "skill").agg(F.count("*").alias("questions"), F.round(100.0 * F.count_if("right") / F.count("*")).cast("int").alias("percent"))


def _scores_sql(pick: str) -> str:
    return f"""WITH one AS (SELECT user_id, skill, k, {pick}(value >= 10, (ts, event_id)) AS "right" FROM answers WHERE k IS NOT NULL GROUP BY ALL)
SELECT user_id, skill, count(*) AS questions, round(100.0 * count(*) FILTER ("right") / count(*))::INT AS percent FROM one GROUP BY ALL"""


@query("first_answer_score", _scores_sql("arg_min"))
def first_answer_score(t: Tables) -> DataFrame:
    """Percent right where the first answer to a question counts."""
    return _scores(t, F.min_by)


@query("last_answer_score", _scores_sql("arg_max"))
def last_answer_score(t: Tables) -> DataFrame:
    """Percent right where the last answer to a question counts."""
    return _scores(t, F.max_by)


PROBLEMS = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS op, l_quantity::BIGINT AS a, l_linenumber::BIGINT AS b, l_partkey % 100 AS said FROM lineitem),
d AS (SELECT *, CASE op WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b ELSE a // b END AS answer FROM p),
m AS (SELECT *, abs(said - answer) AS gap FROM d)
"""


@query("mistake_profile", PROBLEMS + """SELECT op, CASE
  WHEN gap = 0 THEN 'none'
  WHEN op = 0 AND gap IN (10, 100, 1000) THEN 'carry_error' WHEN op = 1 AND gap IN (10, 100) THEN 'borrow_error'
  WHEN op IN (0, 1) AND gap <= 2 THEN 'arithmetic_fact_error'
  WHEN op = 0 AND said = abs(a - b) OR op = 1 AND said = a + b OR op = 2 AND said IN (a + b, a - b) OR op = 3 AND said = a * b THEN 'sign_error'
  WHEN op = 0 THEN 'carry_error' WHEN op = 1 THEN 'borrow_error' ELSE 'arithmetic_fact_error' END AS mistake, count(*) AS n
FROM m GROUP BY ALL""")
def mistake_profile(t: Tables) -> DataFrame:
    """Kinds of mistakes in sums, differences, products and quotients."""
    op, a, b, said = (F.col(c) for c in ("op", "a", "b", "said"))
    p = t.read("lineitem").select((F.col("l_orderkey") % 4).alias("op"), F.col("l_quantity").cast("bigint").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"), (F.col("l_partkey") % 100).alias("said"))
    answer = F.when(op == 0, a + b).when(op == 1, a - b).when(op == 2, a * b).otherwise(F.floor(a / b))
    gap = F.abs(said - answer)
    place = F.when(op == 0, gap.isin(10, 100, 1000)).when(op == 1, gap.isin(10, 100)).otherwise(False)
    swapped = F.when(op == 0, said == F.abs(a - b)).when(op == 1, said == a + b).when(op == 2, (said == a + b) | (said == a - b)).otherwise(said == a * b)
    by_place = F.when(op == 0, "carry_error").when(op == 1, "borrow_error").otherwise("arithmetic_fact_error")
    mistake = F.when(gap == 0, "none").when(place, by_place).when((op <= 1) & (gap <= 2), "arithmetic_fact_error").when(swapped, "sign_error").otherwise(by_place)
    return p.select("op", mistake.alias("mistake")).groupBy("op", "mistake").agg(F.count("*").alias("n"))


def digit_sum(x: Column) -> Column:
    return F.aggregate(F.split(x.cast("string"), ""), F.lit(0), lambda s, d: s + F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))


BASE = {"addition": 0.02, "subtraction": 0.05, "multiplication": 0.10, "division": 0.12}


def borrows(a: Column, b: Column) -> Column:
    """Borrows of a - b, digit by digit from the right."""
    digit = lambda x, i: F.floor(x / F.pow(F.lit(10), i)).cast("bigint") % 10
    start = F.struct(F.lit(0).alias("borrow"), F.lit(0).alias("n"))

    def step(s, i):
        new = F.when(digit(a, i) - digit(b, i) - s["borrow"] < 0, 1).otherwise(0)
        return F.struct(new.alias("borrow"), (s["n"] + new).alias("n"))

    places = F.greatest(F.length(a.cast("string")), F.length(b.cast("string")))
    return F.aggregate(F.sequence(F.lit(0), places - 1), start, step, lambda s: s["n"])


@query("difficulty", """
WITH p AS (SELECT o_orderkey AS id, o_custkey AS a, o_orderkey % 1000 AS b, CASE o_orderkey % 3 WHEN 0 THEN 'addition' WHEN 1 THEN 'subtraction' ELSE 'multiplication' END AS op FROM orders),
s AS (SELECT *, greatest(len(a::VARCHAR), len(b::VARCHAR)) AS digits, list_sum(list_transform(string_split(a::VARCHAR, ''), lambda c: c::INT)) AS sa, list_sum(list_transform(string_split(b::VARCHAR, ''), lambda c: c::INT)) AS sb,
        list_sum(list_transform(string_split((a + b)::VARCHAR, ''), lambda c: c::INT)) AS sab FROM p),
c AS (SELECT *, CASE WHEN op = 'addition' THEN (sa + sb - sab) // 9 ELSE 0 END AS carries,
        CASE WHEN op = 'subtraction' THEN len(list_filter(range(1, digits + 1), lambda i: a % (10 ** i)::BIGINT < b % (10 ** i)::BIGINT)) ELSE 0 END AS borrows FROM s)
SELECT id, op, carries::INT AS carries, borrows::INT AS borrows, round(least(1, CASE op WHEN 'addition' THEN 0.02 WHEN 'subtraction' THEN 0.05 ELSE 0.10 END + 0.08 * digits + 0.12 * carries + 0.14 * borrows), 4)::DOUBLE AS score FROM c""")
def difficulty(t: Tables) -> DataFrame:
    """Carries of sums, from digit sums (each carry takes nine off), borrows of differences, and the score they give."""
    key = F.col("o_orderkey")
    a, b = F.col("o_custkey"), key % 1000
    op = F.when(key % 3 == 0, "addition").when(key % 3 == 1, "subtraction").otherwise("multiplication")
    carries = F.when(op == "addition", (digit_sum(a) + digit_sum(b) - digit_sum(a + b)) / 9).otherwise(0).cast("int")
    digits = F.greatest(F.length(a.cast("string")), F.length(b.cast("string")))
    p = t.read("orders").select(key.alias("id"), op.alias("op"), carries.alias("carries"), F.when(op == "subtraction", borrows(a, b)).otherwise(0).alias("borrows"), digits.alias("digits"))
    base = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))[F.col("op")]
    return p.select("id", "op", "carries", "borrows", F.round(F.least(F.lit(1.0), base + 0.08 * F.col("digits") + 0.12 * F.col("carries") + 0.14 * F.col("borrows")), 4).alias("score"))


@query("lesson_summary", """
SELECT user_id, count(DISTINCT skill) AS total, count(DISTINCT skill) FILTER (ok AND value >= 10) AS completed, count(DISTINCT skill) FILTER (NOT ok) AS reviewed,
       CASE WHEN count(*) FILTER (ok AND value >= 10) > 0 THEN 'homework-done' WHEN count(*) FILTER (NOT ok) > 0 THEN 'reviewed' ELSE 'not-started' END AS status
FROM answers WHERE skill IN ('click', 'purchase', 'view') GROUP BY user_id""")
def lesson_summary(t: Tables) -> DataFrame:
    """Eligible, completed and reviewed skills of each learner, and the status they give."""
    done, seen = F.col("ok") & (F.col("value") >= 10), ~F.col("ok")
    one = t.answers.where(F.col("skill").isin(*KNOWN)).groupBy("user_id", "skill").agg(F.bool_or(done).alias("done"), F.bool_or(seen).alias("seen"))
    g = one.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("done", F.lit(False))).alias("completed"), F.count_if("seen").alias("reviewed"))
    return g.withColumn("status", F.when(F.col("completed") > 0, "homework-done").when(F.col("reviewed") > 0, "reviewed").otherwise("not-started"))
