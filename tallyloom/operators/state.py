"""State changes as pure functions: the rows before and a request give findings and the rows after.

Nothing is updated in place. A batch of requests is judged against the state before it,
so that a retried or repeated batch changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.groups import parts_of
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

SEGMENTS = {"1-URGENT": "BUILDING", "2-HIGH": "MACHINERY", "3-MEDIUM": "HOUSEHOLD"}
RATINGS = {"hard": 1, "ok": 3, "easy": 7}  # fixed values: days until the next review
SHORT_KINDS, SHORT_MS, LONG_MS = ("1-URGENT", "2-HIGH"), 30 * 60 * 1000, 7 * 24 * 60 * 60 * 1000


def preflight(requests: DataFrame, students: DataFrame, tracks: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for each request: status, and the student ids (sorted) behind it.

    requests: request, day, module, track, confirm, action (add, replace or null), student (one row each).
    students: student. tracks: student, track. sessions: student, day, module.
    A request with an unknown student or none at all is not_found; one that needs an
    answer it doesn't have is confirmation_required; any other is assigned.
    """
    asked = requests.distinct()
    known = students.select("student", F.lit(True).alias("known")).distinct()
    enrolled = tracks.select("student", "track", F.lit(True).alias("enrolled")).distinct()
    others = sessions.groupBy("student", "day").agg(F.collect_set("module").alias("held"))
    rows = asked.join(known, "student", "left").join(enrolled, ["student", "track"], "left").join(others, ["student", "day"], "left")
    collides = F.coalesce(F.exists("held", lambda m: m != F.col("module")), F.lit(False))
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("student"))))  # noqa: E731  nulls are not collected
    found = rows.groupBy("request", "day", "module", "track", "confirm", "action").agg(
        listed(F.col("student").isNotNull() & F.col("known").isNull()).alias("unknown"), listed(F.col("known") & F.col("enrolled").isNull()).alias("unenrolled"),
        listed(F.col("known") & collides).alias("collisions"), F.count("student").alias("n"))
    waits = ((F.size("unenrolled") > 0) & ~F.col("confirm")) | ((F.size("collisions") > 0) & F.col("action").isNull())
    status = F.when((F.col("n") == 0) | (F.size("unknown") > 0), "not_found").when(waits, "confirmation_required").otherwise("assigned")
    return found.select("request", status.alias("status"), "unknown", "unenrolled", "collisions")


def commit(requests: DataFrame, verdicts: DataFrame, tracks: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks and sessions after the assigned requests: replaced sessions go, those there stay, new ones come."""
    done = requests.join(verdicts.where("status = 'assigned'").select("request"), "request", "left_semi")
    new_tracks = tracks.select("student", "track").union(done.select("student", "track")).distinct()
    wanted = done.select("student", "day", "module").distinct()
    replaced = done.where("action = 'replace'").select("student", "day", F.col("module").alias("instead")).distinct()
    gone = sessions.join(replaced, ["student", "day"]).where("module <> instead").select("student", "day", "module")
    kept = sessions.select("student", "day", "module").join(gone, ["student", "day", "module"], "left_anti")
    return new_tracks, kept.union(wanted).distinct()


def _assignments(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Odd orders are sessions; the even ones of a day are one request; customers in debt are no students."""
    o = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("student"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("module"))
    segment = F.lit("FURNITURE")
    for module, name in SEGMENTS.items():
        segment = F.when(F.col("module") == module, name).otherwise(segment)
    sessions = o.where("o_orderkey % 2 = 1").select("student", "day", "module").distinct()
    asked = o.where("o_orderkey % 2 = 0").withColumn("module", F.min("module").over(Window.partitionBy("day")))
    day = F.dayofmonth("day")
    asked = asked.select(F.date_format("day", "yyyy-MM-dd").alias("request"), "day", "module", segment.alias("track"), (day % 2 == 1).alias("confirm"), F.when(day % 3 == 1, "add").when(day % 3 == 2, "replace").alias("action"), "student")
    c = t.read("customer")
    students = c.where("c_acctbal >= -900").select(F.col("c_custkey").alias("student"))
    tracks = c.select(F.col("c_custkey").alias("student"), F.col("c_mktsegment").alias("track"))
    return asked, students, tracks, sessions


ASSIGN = """
WITH o AS (SELECT o_orderkey, o_custkey AS student, o_orderdate::DATE AS day, o_orderpriority AS module FROM orders),
s AS (SELECT DISTINCT student, day, module FROM o WHERE o_orderkey % 2 = 1),
r0 AS (SELECT DISTINCT day, student, min(module) OVER (PARTITION BY day) AS module FROM o WHERE o_orderkey % 2 = 0),
r AS (SELECT day::VARCHAR AS request, *, CASE module WHEN '1-URGENT' THEN 'BUILDING' WHEN '2-HIGH' THEN 'MACHINERY' WHEN '3-MEDIUM' THEN 'HOUSEHOLD' ELSE 'FURNITURE' END AS track,
             day(day) % 2 = 1 AS confirm, CASE day(day) % 3 WHEN 1 THEN 'add' WHEN 2 THEN 'replace' END AS action FROM r0),
f AS (SELECT r.*, c_acctbal >= -900 AS known, c_mktsegment = track AS enrolled, EXISTS (SELECT 1 FROM s WHERE s.student = r.student AND s.day = r.day AND s.module <> r.module) AS collides
      FROM r LEFT JOIN customer ON c_custkey = r.student),
v AS (SELECT request, any_value(day) AS day, any_value(module) AS module, any_value(action) AS action, list(student ORDER BY student) FILTER (NOT coalesce(known, false)) AS unknown,
             list(student ORDER BY student) FILTER (known AND NOT enrolled) AS unenrolled, list(student ORDER BY student) FILTER (known AND collides) AS collisions, any_value(confirm) AS confirm FROM f GROUP BY request),
d AS (SELECT *, CASE WHEN len(unknown) > 0 THEN 'not_found' WHEN (len(unenrolled) > 0 AND NOT confirm) OR (len(collisions) > 0 AND action IS NULL) THEN 'confirmation_required' ELSE 'assigned' END AS status FROM v)
"""


@query("assign_preflight", ASSIGN + """SELECT request, status, coalesce(array_to_string(unknown, ','), '') AS unknown, coalesce(array_to_string(unenrolled, ','), '') AS unenrolled, coalesce(array_to_string(collisions, ','), '') AS collisions FROM d""")
def assign_preflight(t: Tables) -> DataFrame:
    """Whether each day's request can be carried out, and whom it concerns otherwise."""
    out = preflight(*_assignments(t))
    return out.select("request", "status", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("unknown", "unenrolled", "collisions")))


@query("assign_commit", ASSIGN + """, done AS (SELECT r.student, r.day, r.module, r.action FROM r JOIN d ON d.request = r.request AND d.status = 'assigned')
SELECT student, day, module FROM s WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.action = 'replace' AND x.student = s.student AND x.day = s.day AND x.module <> s.module)
UNION SELECT student, day, module FROM done""")
def assign_commit(t: Tables) -> DataFrame:
    """The sessions after all requests that could be carried out."""
    requests, students, tracks, sessions = _assignments(t)
    return commit(requests, preflight(requests, students, tracks, sessions), tracks, sessions)[1]


@query("replace_set", """
WITH last AS (SELECT user_id, max(day) AS day FROM activity GROUP BY user_id) SELECT a.user_id AS user_id, a.day AS day, kind FROM activity a JOIN last l ON l.user_id = a.user_id AND l.day = a.day""")
def replace_set(t: Tables) -> DataFrame:
    """What replacing a learner's whole set on each day would have left: the last day's set."""
    sets = t.activity.groupBy("user_id", "day").agg(F.collect_set("kind").alias("kinds"))
    last = sets.groupBy("user_id").agg(F.max("day").alias("day"), F.max_by("kinds", "day").alias("kinds"))
    return last.select("user_id", "day", F.explode("kinds").alias("kind"))


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """A table without the rows of deleted users."""
    return df.join(gone.select(gone.columns[0]).distinct(), df[key] == gone[gone.columns[0]], "left_anti")


@query("cascade_delete", """
WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone))
SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o
UNION ALL SELECT 'lineitem', count(*), sum(l_partkey)::BIGINT FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'events', count(*), sum(event_id)::BIGINT FROM events WHERE user_id NOT IN (SELECT id FROM gone)""")
def cascade_delete(t: Tables) -> DataFrame:
    """What is left of each table when learners with a negative balance are deleted, with all that hangs on them."""
    gone = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("gone_id"))
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    removed = orders.join(gone, orders.o_custkey == gone.gone_id, "left_semi").select(F.col("o_orderkey").alias("gone_order"))
    left = {
        "customer": (without(t.read("customer"), "c_custkey", gone), "c_custkey"), "orders": (without(orders, "o_custkey", gone), "o_orderkey"),
        "lineitem": (without(t.read("lineitem"), "l_orderkey", removed), "l_partkey"), "events": (without(t.read("events"), "user_id", gone), "event_id"),
    }
    parts = [df.agg(F.count("*").alias("n"), F.sum(key).alias("key_sum")).select(F.lit(name).alias("name"), "n", "key_sum") for name, (df, key) in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("rating_step", """
WITH r AS (SELECT *, CASE WHEN NOT ok THEN 'hard' WHEN value < 20 THEN 'ok' ELSE 'easy' END AS rating FROM answers)
SELECT user_id, skill, count(*) AS repetitions, CASE arg_max(rating, (ts, event_id)) WHEN 'hard' THEN 1 WHEN 'ok' THEN 3 ELSE 7 END AS interval_days,
       max(ts)::DATE + CASE arg_max(rating, (ts, event_id)) WHEN 'hard' THEN 1 WHEN 'ok' THEN 3 ELSE 7 END AS next_review, count(*) FILTER (rating <> 'hard') AS correct_n, count(*) FILTER (rating = 'hard') AS wrong_n
FROM r GROUP BY user_id, skill""")
def rating_step(t: Tables) -> DataFrame:
    """State of each skill where every rating overwrites the interval: the last one counts, counters add up."""
    rating = F.when(~F.col("ok"), "hard").when(F.col("value") < 20, "ok").otherwise("easy")
    days = F.create_map(*(x for k, v in RATINGS.items() for x in (F.lit(k), F.lit(v))))
    g = t.answers.withColumn("rating", rating).groupBy("user_id", "skill").agg(
        F.count("*").alias("repetitions"), F.max_by("rating", F.struct("ts", "event_id")).alias("last"), F.to_date(F.max("ts")).alias("day"),
        F.count_if(F.col("rating") != "hard").alias("correct_n"), F.count_if(F.col("rating") == "hard").alias("wrong_n"))
    g = g.withColumn("interval_days", F.element_at(days, F.col("last")))
    return g.select("user_id", "skill", "repetitions", "interval_days", F.expr("date_add(day, interval_days)").alias("next_review"), "correct_n", "wrong_n")


@query("finish_once", """
SELECT l_orderkey AS id, min(l_shipdate)::DATE AS finished, arg_min(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_quantity)) AS points, count(*) - 1 AS replays FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL""")
def finish_once(t: Tables) -> DataFrame:
    """The first finishing event of each attempt counts; how many came after it."""
    f = t.read("lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("id"))
    first = F.min(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity"))
    return f.agg(first.alias("f"), (F.count("*") - 1).alias("replays")).select("id", F.to_date("f.l_shipdate").alias("finished"), F.col("f.l_quantity").alias("points"), "replays")


@query("first_unanswered", """
WITH q AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, list(DISTINCT l_partkey) FILTER (l_returnflag <> 'N') AS answered FROM lineitem GROUP BY ALL)
SELECT id, len(ids)::INT AS questions, (list_position(list_transform(ids, lambda x: NOT list_contains(coalesce(answered, []), x)), true) - 1)::INT AS next FROM q WHERE list_position(list_transform(ids, lambda x: NOT list_contains(coalesce(answered, []), x)), true) > 0
UNION ALL SELECT id, len(ids)::INT, -1 FROM q WHERE coalesce(list_position(list_transform(ids, lambda x: NOT list_contains(coalesce(answered, []), x)), true), 0) = 0""")
def first_unanswered(t: Tables) -> DataFrame:
    """Position of the first question without an answer; -1 if all have one."""
    lines = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("q"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("answered"))
    open_ = F.transform("q", lambda x: ~F.array_contains("answered", x["l_partkey"]))
    return lines.select("id", F.size("q").alias("questions"), (F.array_position(open_, F.lit(True)) - 1).cast("int").alias("next"))


@query("draft_state", """
WITH a AS (SELECT kind, epoch_ms(TIMESTAMP '1998-06-15 00:10:00') - epoch_ms(started) AS age, CASE WHEN kind IN ('1-URGENT', '2-HIGH') THEN 1800000 ELSE 604800000 END AS ttl FROM attempts)
SELECT kind, CASE WHEN age < 0 THEN 'future' WHEN age <= ttl THEN 'valid' ELSE 'stale' END AS state, count(*) AS n FROM a GROUP BY ALL""")
def draft_state(t: Tables) -> DataFrame:
    """Drafts that still hold at a given time: not from the future, and within the time to live of their kind."""
    now = F.lit("1998-06-15 00:10:00").cast("timestamp")
    age = F.unix_millis(now) - F.unix_millis(F.col("started").cast("timestamp"))
    ttl = F.when(F.col("kind").isin(*SHORT_KINDS), SHORT_MS).otherwise(LONG_MS)
    orders = t.attempts.select("kind", age.alias("age"), ttl.alias("ttl"))
    state = F.when(F.col("age") < 0, "future").when(F.col("age") <= F.col("ttl"), "valid").otherwise("stale")
    return orders.groupBy("kind", state.alias("state")).agg(F.count("*").alias("n"))


@query("exam_score", """
WITH asked AS (SELECT o_orderkey AS id, unnest(range(1, 2 + o_orderkey % 7)) AS q FROM orders),
said AS (SELECT l_orderkey AS id, l_linenumber AS q, count(*) AS n, min(l_partkey % 4) AS answer, min(l_suppkey % 4) AS key FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(asked.id, said.id) AS id, asked.q IS NOT NULL AS is_asked, coalesce(n, 0) AS n, answer = key AS ok, 1 + (asked.id + asked.q) % 4 AS points FROM asked FULL JOIN said ON asked.id = said.id AND asked.q = said.q),
e AS (SELECT id, count(*) FILTER (is_asked) AS asked, count(*) FILTER (is_asked AND n = 0) AS missing, count(*) FILTER (NOT is_asked) AS foreign_n, count(*) FILTER (n > 1) AS repeated, sum(CASE WHEN ok AND is_asked THEN points ELSE 0 END)::BIGINT AS earned, sum(CASE WHEN is_asked THEN points END)::BIGINT AS possible FROM j GROUP BY id),
v AS (SELECT *, CASE WHEN asked = 0 THEN 'unknown' WHEN missing > 0 THEN 'incomplete' WHEN foreign_n > 0 THEN 'foreign' WHEN repeated > 0 THEN 'repeated' ELSE 'graded' END AS status FROM e)
SELECT id, status, asked, missing, CASE WHEN status = 'graded' THEN earned END AS earned, CASE WHEN status = 'graded' THEN possible END AS possible, CASE WHEN status = 'graded' THEN CASE WHEN possible > 0 THEN floor(100.0 * earned / possible + 0.5)::INT ELSE 0 END END AS percent FROM v""")
def exam_score(t: Tables) -> DataFrame:
    """Points of each attempt whose asked questions have all been answered once, and no others.

    What is asked is a table of its own, with the points: a last question that nobody
    answered makes an attempt incomplete. Else an answer may be foreign (not asked) or
    repeated; an attempt without questions is unknown.
    """
    orders, lines = t.read("orders"), t.read("lineitem")
    key, asking, said, none = F.col("o_orderkey"), F.col("asking"), ~F.col("asking"), F.lit(None)
    asked = orders.select(key.alias("id"), F.lit(True).alias("asking"), none.cast("bigint").alias("q"), none.cast("bigint").alias("answer"), none.cast("bigint").alias("key"))
    answers = lines.select(F.col("l_orderkey").alias("id"), F.lit(False).alias("asking"), F.col("l_linenumber").cast("bigint").alias("q"), (F.col("l_partkey") % 4).alias("answer"), (F.col("l_suppkey") % 4).alias("key"))
    # dealt out once by attempt, before anything is counted: questions are nearly all different, so that counting them first would only fill memory
    rows = asked.unionByName(answers).repartition(parts_of(orders, lines), "id")
    numbers = F.when(asking, F.sequence(F.lit(1).cast("bigint"), F.col("id") % 7 + 1)).otherwise(F.array("q"))
    rows = rows.select("id", "asking", "answer", "key", F.explode(numbers).alias("q"))
    j = rows.groupBy("id", "q").agg(F.count_if(asking).alias("times"), F.count_if(said).alias("n"), F.min("answer").alias("answer"), F.min("key").alias("key"))
    times, points = F.col("times"), F.col("times") * ((F.col("id") + F.col("q")) % 4 + 1)
    is_asked = times > 0
    e = j.groupBy("id").agg(
        F.sum(times).alias("asked"), F.sum(F.when(F.col("n") == 0, times).otherwise(0)).alias("missing"), F.count_if(~is_asked).alias("foreign"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.sum(F.when(is_asked & (F.col("answer") == F.col("key")), points).otherwise(0)).alias("earned"), F.sum(F.when(is_asked, points)).alias("possible"))
    status = F.when(F.col("asked") == 0, "unknown").when(F.col("missing") > 0, "incomplete").when(F.col("foreign") > 0, "foreign").when(F.col("repeated") > 0, "repeated").otherwise("graded")
    whole = status == "graded"
    percent = F.when(F.col("possible") > 0, F.floor(100.0 * F.col("earned") / F.col("possible") + 0.5)).otherwise(0).cast("int")
    return e.select("id", status.alias("status"), "asked", "missing", *(F.when(whole, c).alias(n) for c, n in ((F.col("earned"), "earned"), (F.col("possible"), "possible"), (percent, "percent"))))


@query("homework_score", """
WITH a AS (SELECT l_orderkey AS id, l_linenumber <= 4 AS matching, p_brand = 'Brand#' || (l_partkey % 25) AS exact, lower(trim(CASE WHEN l_partkey % 3 = 0 THEN '  ' || upper(p_name) || ' ' ELSE reverse(p_name) END)) = lower(trim(p_name || ' ')) AS blank
           FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT id, count(*) FILTER (matching AND exact) AS matched, count(*) FILTER (NOT matching AND blank) AS filled, floor(100.0 * (count(*) FILTER (matching AND exact) + count(*) FILTER (NOT matching AND blank)) / count(*) + 0.5)::INT AS score FROM a GROUP BY id""")
def homework_score(t: Tables) -> DataFrame:
    """Matching answers count if they are equal, filled blanks if they are after trimming and lower-casing."""
    p = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    a = t.read("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey").join(p, "l_partkey")
    said = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.reverse("p_name"))
    matched = (F.col("l_linenumber") <= 4) & (F.col("p_brand") == F.concat(F.lit("Brand#"), F.col("l_partkey") % 25))
    filled = (F.col("l_linenumber") > 4) & (F.lower(F.trim(said)) == F.lower(F.trim(F.concat("p_name", F.lit(" ")))))
    g = a.groupBy("id").agg(F.count_if(matched).alias("matched"), F.count_if(filled).alias("filled"), F.count("*").alias("n"))
    return g.select("id", "matched", "filled", F.floor(100.0 * (F.col("matched") + F.col("filled")) / F.col("n") + 0.5).cast("int").alias("score"))


@query("section_lookup", """
WITH s AS (SELECT l_orderkey AS exam, min(l_linestatus) AS slug, min(l_returnflag) AS stimulus, list_sort(list(DISTINCT l_linenumber)) AS ids FROM lineitem GROUP BY l_orderkey),
x AS (SELECT exam, slug, stimulus, unnest(ids) AS number, generate_subscripts(ids, 1) - 1 AS pos FROM s)
SELECT exam, pos::INT AS pos, number, l_partkey AS part FROM x JOIN lineitem ON l_orderkey = exam AND l_linenumber = number AND l_linestatus = slug AND l_returnflag = stimulus""")
def section_lookup(t: Tables) -> DataFrame:
    """Questions listed by a section, in its order, where exam, section and stimulus agree as well."""
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("number"), F.col("l_linestatus").alias("slug"), F.col("l_returnflag").alias("stimulus"), F.col("l_partkey").alias("part"))
    s = lines.groupBy("exam").agg(F.min("slug").alias("slug"), F.min("stimulus").alias("stimulus"), F.sort_array(F.collect_set("number")).alias("ids"))
    listed = s.select("exam", "slug", "stimulus", F.posexplode("ids").alias("pos", "number"))
    return listed.join(lines, ["exam", "number", "slug", "stimulus"]).select("exam", "pos", "number", "part")


@query("refresh_hash", """
WITH old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE sha256(c_name) END AS h, c_name AS explanation FROM customer WHERE c_custkey % 11 <> 0),
new AS (SELECT c_custkey AS id, sha256(c_name) AS h FROM customer WHERE c_custkey % 13 <> 0)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'not stored' WHEN new.id IS NULL THEN 'not expected' WHEN old.h <> new.h THEN 'refreshed' ELSE 'same' END AS state, coalesce(new.h, old.h) AS hash, explanation FROM old FULL JOIN new ON old.id = new.id""")
def refresh_hash(t: Tables) -> DataFrame:
    """Stored records with their hash renewed and everything else kept; ids that one side lacks are told."""
    c = t.read("customer")
    record = F.struct(F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.sha2("c_name", 256)).alias("inputHash"), F.col("c_name").alias("explanation"))
    old = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"), record.alias("record"))
    new = c.where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("fresh"))
    both = old.join(new, "id", "full")
    state = F.when(F.col("record").isNull(), "not stored").when(F.col("fresh").isNull(), "not expected").when(F.col("record.inputHash") != F.col("fresh"), "refreshed").otherwise("same")
    kept = both.select("id", state.alias("state"), F.col("record").withField("inputHash", F.coalesce("fresh", "record.inputHash")).alias("record"), "fresh")
    return kept.select("id", "state", F.coalesce("record.inputHash", "fresh").alias("hash"), F.col("record.explanation").alias("explanation"))


@query("missed_queue", """
WITH m AS (SELECT user_id, skill, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM answers WHERE NOT ok)
SELECT user_id, string_agg(skill, ',' ORDER BY ts, event_id) AS queue FROM m WHERE back <= 10 GROUP BY user_id""")
def missed_queue(t: Tables) -> DataFrame:
    """The last ten missed skills of each learner, oldest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    m = t.answers.where("not ok").select("user_id", "skill", "ts", "event_id", F.row_number().over(w).alias("back")).where("back <= 10")
    g = m.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "skill"))).alias("q"))
    return g.select("user_id", F.array_join(F.transform("q", lambda x: x["skill"]), ",").alias("queue"))
