"""Nested documents: packing rows into them and flattening them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables


@query("conversation_pack", """
SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn, role) AS roles, sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, ''))) AS hash
FROM conversations GROUP BY conv_id""")
def conversation_pack(t: Tables) -> DataFrame:
    """Each conversation as one ordered list of turns, and its digest."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    g = t.read("conversations").groupBy("conv_id").agg(turns.alias("t"), F.sum(F.length("text")).alias("chars"))
    return g.select("conv_id", F.size("t").cast("bigint").alias("turns"), "chars", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"),
                    F.sha2(F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["role"], x["text"])), "\n"), 256).alias("hash"))


def documents(t: Tables) -> DataFrame:
    """Each order's lines as one document: id, and an array of questions with grading inside."""
    q = F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.struct(F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("points")).alias("grading"))
    return t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(q)).alias("questions"))


def exams(t: Tables) -> DataFrame:
    """Documents with their section."""
    return t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("section")).join(documents(t), "id")


@query("catalog_flatten", """
SELECT l_orderkey AS id, o_orderpriority AS section, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) - 1)::INT AS pos, l_linenumber AS number, l_partkey AS part
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def catalog_flatten(t: Tables) -> DataFrame:
    """Questions as rows, without their grading."""
    public = exams(t).withColumn("questions", F.transform("questions", lambda q: q.dropFields("grading")))
    return public.select("id", "section", F.posexplode("questions").alias("pos", "q")).select("id", "section", "pos", F.col("q.number").alias("number"), F.col("q.part").alias("part"))


@query("catalog_violations", """
WITH q AS (SELECT l_orderkey AS id, count(*) AS n, count(DISTINCT l_linenumber) AS d, count(*) FILTER (l_quantity <= 0) AS none, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY ALL)
SELECT id, concat_ws(',', CASE WHEN n > 7 THEN 'too_long' END, CASE WHEN d < n THEN 'duplicate_number' END, CASE WHEN none > 0 THEN 'no_points' END, CASE WHEN last - first + 1 <> d THEN 'gap' END) AS codes
FROM q WHERE n > 7 OR d < n OR none > 0 OR last - first + 1 <> d""")
def catalog_violations(t: Tables) -> DataFrame:
    """All rules that a document breaks, in a fixed order; documents without any don't appear."""
    q = F.col("questions")
    numbers = F.array_distinct(F.transform(q, lambda x: x["number"]))
    checks = F.array_compact(F.array(
        F.when(F.size(q) > 7, "too_long"), F.when(F.size(numbers) < F.size(q), "duplicate_number"), F.when(F.exists(q, lambda x: x["grading"]["points"] <= 0), "no_points"),
        F.when(F.array_max(numbers) - F.array_min(numbers) + 1 != F.size(numbers), "gap")))
    return documents(t).select("id", checks.alias("codes")).where(F.size("codes") > 0).select("id", F.array_join("codes", ",").alias("codes"))


@query("nested_sums", """
WITH n AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS p, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT id, len(p)::INT AS n, list_sum(p) AS points, list_sum(p[:8]) AS first8, len(list_distinct(m))::INT AS modes FROM n""")
def nested_sums(t: Tables) -> DataFrame:
    """Sums over nested sizes, the first eight only, and distinct values in order."""
    points = F.transform("questions", lambda q: q["grading"]["points"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return documents(t).select("id", F.size("questions").alias("n"), total(points).alias("points"), total(F.slice(points, 1, 8)).alias("first8"), F.size(F.array_distinct(F.transform("questions", lambda q: q["grading"]["mode"]))).alias("modes"))


@query("zip_join", """
WITH a AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, l_partkey FROM lineitem),
b AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS pos, l_partkey FROM lineitem)
SELECT a.id AS id, count(*) FILTER (a.l_partkey = b.l_partkey) AS same FROM a JOIN b ON a.id = b.id AND a.pos = b.pos GROUP BY ALL""")
def zip_join(t: Tables) -> DataFrame:
    """Positions at which two orders of a document's items agree."""
    a = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    b = F.sort_array(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), F.col("l_partkey").alias("part"))))
    g = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(a.alias("a"), b.alias("b"))
    return g.select("id", F.size(F.filter(F.arrays_zip("a", "b"), lambda z: z["a"]["l_partkey"] == z["b"]["part"])).cast("bigint").alias("same"))
