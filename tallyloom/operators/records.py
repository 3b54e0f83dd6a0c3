"""Row-level state: snapshots, expiry, pinned overrides, ranges, names and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.calendar import clock
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables
from tallyloom.sources.documents import CheckedJson


@query("latest_snapshot", "SELECT user_id, skill, arg_max(value, (ts, event_id)) AS value, arg_min(value, (ts, event_id)) AS first_value, count(*) AS writes FROM answers GROUP BY ALL")
def latest_snapshot(t: Tables) -> DataFrame:
    """What overwriting, and what keeping the first, would have left of each key."""
    at = F.struct("ts", "event_id")
    return t.answers.groupBy("user_id", "skill").agg(F.max_by("value", at).alias("value"), F.min_by("value", at).alias("first_value"), F.count("*").alias("writes"))


@query("expired", "SELECT id, user_id, started, clock FROM (SELECT *, printf('%d:%02d', duration_ms // 1000 // 60, (duration_ms // 1000) % 60) AS clock FROM attempts) WHERE correct < total AND duration_ms NOT BETWEEN 0 AND 90 * 86400000::BIGINT")
def expired(t: Tables) -> DataFrame:
    """Unfinished attempts past their time to live, or from the future."""
    ttl = F.lit(90 * 86_400_000)
    return t.attempts.where((F.col("correct") < F.col("total")) & ~F.col("duration_ms").between(0, ttl)).select("id", "user_id", "started", clock(F.col("duration_ms")).alias("clock"))


@query("canonical_hash", """
SELECT c_custkey AS id, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '","note":null,"track":"' || c_mktsegment || '"}') AS hash FROM customer""")
def canonical_hash(t: Tables) -> DataFrame:
    """SHA-256 of each record as JSON with sorted keys and explicit nulls."""
    record = F.struct("id", "name", F.lit(None).cast("string").alias("note"), "track")
    return t.learners.select("id", F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256).alias("hash"))


@query("pinned_override", """
WITH o AS (SELECT o_orderkey AS id, sha256(o_orderkey || ':' || o_orderpriority) AS hash, o_orderpriority AS value FROM orders),
p AS (SELECT id, CASE WHEN id % 2 = 0 THEN hash ELSE 'stale' END AS hash, 'reviewed' AS better FROM o WHERE id % 3 = 0)
SELECT o.id AS id, coalesce(better, value) AS value, p.id IS NOT NULL AND better_ok IS NULL AS mismatch
FROM o LEFT JOIN p ON p.id = o.id AND p.hash = o.hash LEFT JOIN (SELECT id, 1 AS better_ok FROM o) x ON x.id = p.id""".replace("p.id IS NOT NULL AND better_ok IS NULL", "o.id % 3 = 0 AND p.id IS NULL"))
def pinned_override(t: Tables) -> DataFrame:
    """Reviewed values apply only where the stored hash is the present one; others are reported."""
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws(":", "o_orderkey", "o_orderpriority"), 256).alias("hash"), F.col("o_orderpriority").alias("value"))
    p = o.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("hash")).otherwise("stale").alias("pinned"), F.lit("reviewed").alias("better"))
    fits = F.col("pinned") == F.col("hash")
    return o.join(p, "id", "left").select("id", F.when(fits, F.col("better")).otherwise(F.col("value")).alias("value"), F.coalesce(~fits, F.lit(False)).alias("mismatch"))


BANDS = 4


@query("range_link", f"""
WITH b AS (SELECT n_nationkey AS grp, i AS band, -1000 + i * 2750 AS lo, -1000 + (i + 1) * 2750 - 0.01 AS hi FROM nation, (SELECT unnest(range({BANDS})) AS i))
SELECT l.c_custkey AS id, grp, band::INT AS band FROM customer l JOIN b ON grp = c_nationkey AND c_acctbal BETWEEN lo AND hi""")
def range_link(t: Tables) -> DataFrame:
    """Each learner's band: equal group, balance between the band's bounds."""
    bands = t.read("nation").select(F.col("n_nationkey").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    bands = bands.withColumns({"lo": -1000 + F.col("band") * 2750.0, "hi": -1000 + (F.col("band") + 1) * 2750.0 - 0.01})
    c = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), "c_acctbal")
    return c.join(bands, "grp").where(F.col("c_acctbal").between(F.col("lo"), F.col("hi"))).select("id", "grp", "band")


@query("overlap_check", """
WITH r AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
v AS (SELECT conv_id, count(*) FILTER (turn - before <> 1) AS gaps FROM s GROUP BY conv_id)
SELECT r.conv_id AS conv_id, lo, hi, gaps, hi - lo + 1 = n AS whole FROM r JOIN v USING (conv_id)""")
def overlap_check(t: Tables) -> DataFrame:
    """Strictly increasing numbers without gaps, for each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = t.read("conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"))
    g = s.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("turn") - F.col("before") != 1).alias("gaps"))
    return g.select("conv_id", "lo", "hi", "gaps", (F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("whole"))


@query("text_keys", """
SELECT p_partkey AS id, trim(regexp_replace(upper(p_name), '\\s+', ' ', 'g')) AS name, split_part(p_brand, '#', 2) AS brand_no, lpad(p_size::VARCHAR, 4, '0') AS size_key,
       p_partkey || ':' || p_size AS item_key, upper(p_name[1]) || p_name[2:] AS title, regexp_replace(p_name, '[^a-z0-9-]', '-', 'g') AS slug,
       p_size || CASE WHEN p_size = 1 THEN ' word' ELSE ' words' END AS label, regexp_matches(p_name, '^[A-Za-z ]{2,80}$') AS valid,
       CASE WHEN p_size >= 37 THEN 'high' WHEN p_size >= 20 THEN 'middle' ELSE 'low' END AS band, least(p_size * 2, 7) AS capped, abs(levenshtein(p_type, 'SMALL')) = 1 AS close
FROM part""")
def text_keys(t: Tables) -> DataFrame:
    """Normalised names, keys, slugs, labels, bands and validity."""
    size, name = F.col("p_size"), F.col("p_name")
    band = F.when(size >= 37, "high").when(size >= 20, "middle").otherwise("low")
    return t.read("part").select(
        F.col("p_partkey").alias("id"), F.trim(F.regexp_replace(F.upper(name), r"\s+", " ")).alias("name"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"),
        F.lpad(size.cast("string"), 4, "0").alias("size_key"), F.concat_ws(":", "p_partkey", "p_size").alias("item_key"), F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(p_name, 2)")).alias("title"),
        F.regexp_replace(name, "[^a-z0-9-]", "-").alias("slug"), F.concat(size.cast("string"), F.when(size == 1, " word").otherwise(" words")).alias("label"),
        name.rlike("^[A-Za-z ]{2,80}$").alias("valid"), band.alias("band"), F.least(size * 2, F.lit(7)).alias("capped"), (F.levenshtein("p_type", F.lit("SMALL")) == 1).alias("close"))


@query("json_fields", """
SELECT event_id, (props->>'k')::INT AS k, greatest(0, least(1, (props->>'k')::INT / 100.0))::DOUBLE AS share, (props->>'missing') IS NULL AS absent, '[' || (props->>'k') || ']' AS list FROM events""")
def json_fields(t: Tables) -> DataFrame:
    """Known fields of a JSON column, clamped; unknown or broken ones are null."""
    m = F.from_json("props", "map<string,int>")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_element_at(m, F.lit("k")) / 100.0))
    return t.read("events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), share.alias("share"), F.try_element_at(m, F.lit("missing")).isNull().alias("absent"), F.to_json(F.map_values(m)).alias("list"))


@query("props_documents", """
SELECT event_id, json(props)::VARCHAR AS doc, (props->>'k')::INT AS k, NULL::VARCHAR AS problem FROM events WHERE props IS NOT NULL""")
def props_documents(t: Tables) -> DataFrame:
    """The events' properties as checked documents, read by the data source: canonical spelling, one field, and what is wrong with a bad one."""
    t.spark.dataSource.register(CheckedJson)
    docs = t.spark.read.format(CheckedJson.name()).option("column", "props").option("key", "event_id").load(f"{t.sf_dir}/events.parquet")
    return docs.select(F.col("key").cast("bigint").alias("event_id"), "doc", F.from_json("doc", "k int")["k"].alias("k"), "problem")
