"""Rosters, cohort reports, set comparisons and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.progress import srs
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables


@query("roster_tracks", """
SELECT n_nationkey AS grp, n_name AS name, coalesce(string_agg(DISTINCT track, ',' ORDER BY track), '') AS tracks, count(DISTINCT l.id) AS learners
FROM nation LEFT JOIN learners l ON grp = n_nationkey GROUP BY n_nationkey, n_name""")
def roster_tracks(t: Tables) -> DataFrame:
    """Every group with the list of its learners' tracks, groups without learners too."""
    by_track = t.learners.groupBy("grp", "track").agg(F.count("*").alias("n"))
    lists = by_track.groupBy("grp").agg(F.array_join(F.sort_array(F.collect_set("track")), ",").alias("tracks"), F.sum("n").alias("learners"))
    n = t.read("nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("name"))
    return n.join(lists, "grp", "left").select("grp", "name", F.coalesce("tracks", F.lit("")).alias("tracks"), F.coalesce("learners", F.lit(0)).alias("learners"))


@query("type_counts", """
WITH kinds AS (SELECT DISTINCT kind FROM attempts), one AS (SELECT kind, count(*) AS n FROM attempts JOIN learners l ON l.id = user_id WHERE grp = 0 AND total >= 9 GROUP BY kind)
SELECT kind, coalesce(n, 0) AS n FROM kinds LEFT JOIN one USING (kind)""")
def type_counts(t: Tables) -> DataFrame:
    """Long attempts of one group counted by kind, kinds without any as zero."""
    group = t.learners.where("grp = 0").select(F.col("id").alias("user_id"))
    n = t.attempts.where("total >= 9").join(group, "user_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))
    return t.attempts.select("kind").distinct().join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("distinct_taught", """
SELECT DISTINCT kind FROM activity WHERE day <= DATE '2024-01-15' AND kind IN (SELECT skill FROM answers WHERE ok)""")
def distinct_taught(t: Tables) -> DataFrame:
    """Kinds seen up to a day that also have a right answer."""
    seen = t.activity.where(F.col("day") <= F.lit("2024-01-15").cast("date")).select("kind").distinct()
    return seen.join(t.answers.where("ok").select(F.col("skill").alias("kind")).distinct(), "kind", "left_semi")


@query("anti_backfill", """
SELECT l.id AS id, coalesce(CASE WHEN l.grp BETWEEN 3 AND 8 THEN l.grp END, 3) AS grade FROM learners l
WHERE l.id IN (SELECT user_id FROM attempts) AND l.id NOT IN (SELECT user_id FROM attempts WHERE kind = '1-URGENT')""")
def anti_backfill(t: Tables) -> DataFrame:
    """Default grade for learners who have attempts but none of the timed kind."""
    has = t.attempts.select(F.col("user_id").alias("id")).distinct()
    timed = t.attempts.where(F.col("kind") == "1-URGENT").select(F.col("user_id").alias("id")).distinct()
    grade = F.coalesce(F.when(F.col("grp").between(3, 8), F.col("grp")), F.lit(3))
    return t.learners.join(has, "id", "left_semi").join(timed, "id", "left_anti").select("id", grade.alias("grade"))


@query("missing_ids", """
WITH u AS (SELECT DISTINCT user_id AS id FROM events)
SELECT coalesce(l.id, u.id) AS id, CASE WHEN l.id IS NULL THEN 'orphaned' ELSE 'missing' END AS side
FROM learners l FULL JOIN u ON l.id = u.id WHERE l.id IS NULL OR u.id IS NULL""")
def missing_ids(t: Tables) -> DataFrame:
    """Symmetric difference of two id sets, with the side each id lacks."""
    l, u = t.learners.select("id", F.lit(True).alias("l")), t.read("events").select(F.col("user_id").alias("id")).distinct().withColumn("u", F.lit(True))
    both = l.join(u, "id", "full")
    return both.where("l is null or u is null").select("id", F.when(F.col("l").isNull(), "orphaned").otherwise("missing").alias("side"))


SMALL_SIDE = 1_000_000  # cells of one domain that are broadcast, counted first


@query("matrix_gaps", """
WITH cells AS (SELECT n_nationkey AS grp, p_brand AS brand FROM nation, (SELECT DISTINCT p_brand FROM part)),
there AS (SELECT DISTINCT s_nationkey AS grp, p_brand AS brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50)
SELECT grp, brand FROM cells EXCEPT SELECT grp, brand FROM there""")
def matrix_gaps(t: Tables) -> DataFrame:
    """Cells of two domains (groups, brands) without any row. Both are counted, and the smaller one is broadcast if it may be."""
    brands = t.read("part").select(F.col("p_brand").alias("brand")).distinct()
    groups = t.read("nation").select(F.col("n_nationkey").alias("grp"))
    many, few = sorted((brands, groups), key=DataFrame.count, reverse=True)
    cells = many.crossJoin(F.broadcast(few) if few.count() <= SMALL_SIDE else few).select("grp", "brand")
    lines = t.read("lineitem").where("l_quantity >= 50").select("l_suppkey", "l_partkey")
    there = lines.join(t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("grp")), "l_suppkey")
    there = there.join(t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey").select("grp", "brand").distinct()
    return cells.join(there, ["grp", "brand"], "left_anti")


@query("struggling_words", """
WITH s AS (SELECT *, user_id % 7 AS grp FROM srs WHERE wrong_n > correct_n OR (correct_n < 2 AND seen > 1)),
a AS (SELECT skill, count(DISTINCT user_id) AS users, arg_max(grp, (wrong_n, -user_id)) AS first_grp FROM s GROUP BY skill),
b AS (SELECT grp, skill, count(DISTINCT user_id) AS users FROM s GROUP BY grp, skill),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY users DESC, skill) AS rank FROM b)
SELECT r.grp AS grp, r.skill AS skill, r.users AS users, rank, a.users AS all_users, first_grp FROM r JOIN a USING (skill) WHERE rank <= 8""")
def struggling_words(t: Tables) -> DataFrame:
    """Struggled-with skills: distinct learners overall and by group, eight at most for each group."""
    s = srs(t).where("wrong_n > correct_n or (correct_n < 2 and seen > 1)").withColumn("grp", F.col("user_id") % 7)
    overall = s.groupBy("skill").agg(F.count_distinct("user_id").alias("all_users"), F.max_by("grp", F.struct("wrong_n", -F.col("user_id"))).alias("first_grp"))
    by_group = s.groupBy("grp", "skill").agg(F.count_distinct("user_id").alias("users"))
    w = Window.partitionBy("grp").orderBy(F.desc("users"), "skill")
    return by_group.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 8").join(overall, "skill").select("grp", "skill", "users", "rank", "all_users", "first_grp")


@query("attendance_grid", """
WITH months AS (SELECT DISTINCT date_trunc('month', started)::DATE AS month FROM attempts WHERE year(started) = 1997),
held AS (SELECT user_id, date_trunc('month', started)::DATE AS month, count(*) AS n, bool_or(correct = total) AS present FROM attempts WHERE year(started) = 1997 GROUP BY ALL)
SELECT l.id AS id, m.month AS month, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN present THEN 'present' ELSE 'absent' END AS mark
FROM learners l CROSS JOIN months m LEFT JOIN held h ON h.user_id = l.id AND h.month = m.month""")
def attendance_grid(t: Tables) -> DataFrame:
    """Every learner in every month of a year (twelve at most), with lookups into what was held."""
    year = t.attempts.where(F.year("started") == 1997).withColumn("month", F.trunc(F.to_date("started"), "month"))
    held = year.groupBy(F.col("user_id").alias("id"), "month").agg(F.count("*").alias("n"), F.bool_or(F.col("correct") == F.col("total")).alias("present"))
    grid = t.learners.select("id").crossJoin(F.broadcast(year.select("month").distinct()))  # at most twelve rows
    mark = F.when(F.col("n").isNull(), "none").when(F.col("present"), "present").otherwise("absent")
    return grid.join(held, ["id", "month"], "left").select("id", "month", F.coalesce("n", F.lit(0)).alias("n"), mark.alias("mark"))


@query("collisions", """
SELECT a.user_id AS user_id, a.started::DATE AS day, a.id AS id, count(*) AS others FROM attempts a
JOIN attempts b ON a.user_id = b.user_id AND a.started = b.started AND a.kind <> b.kind GROUP BY ALL""")
def collisions(t: Tables) -> DataFrame:
    """Attempts that share learner and day with one of another kind, from counts in place of a self-join."""
    day = t.attempts.select("user_id", F.to_date("started").alias("day"), "id", "kind")
    whole = Window.partitionBy("user_id", "day")
    kind = Window.partitionBy("user_id", "day", "kind")
    return day.withColumn("others", F.count("*").over(whole) - F.count("*").over(kind)).where("others > 0").select("user_id", "day", "id", "others")


@query("unique_names", """
SELECT lower(trim(p_name)) AS name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL HAVING count(*) > 1""")
def unique_names(t: Tables) -> DataFrame:
    """Violations of uniqueness after normalising."""
    return t.read("part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("visible_rows", """
SELECT a.id AS id, a.user_id AS user_id FROM attempts a JOIN learners l ON l.id = a.user_id
WHERE track IN ('BUILDING', 'MACHINERY') AND grp = 7 AND NOT (kind = '5-LOW')""")
def visible_rows(t: Tables) -> DataFrame:
    """Access predicate: track among those allowed, group equal, kind permitted."""
    seen = t.learners.where(F.col("track").isin("BUILDING", "MACHINERY") & (F.col("grp") == 7)).select(F.col("id").alias("user_id"))
    return t.attempts.where(F.col("kind") != "5-LOW").join(seen, "user_id", "left_semi").select("id", "user_id")
