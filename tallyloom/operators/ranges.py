"""Ranges named in free text, and points met with the ranges that hold them.

interval_join() needs no equality key. A range of length n lies in at most two blocks of
the smallest power of eight that is not below n; it is met under that size and those
blocks. A point is looked up once for each size that occurs, of which there are at most
22. Ranges double, points are multiplied by the sizes in use, and the join is one of equal
keys, whatever the ranges' lengths; no task gets all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

#: A direction to answer a range of questions, in our own wording: two numbers after the word, joined by a word or a dash.
DIRECTION = r"(?i)\bquestions?\s+([0-9]{1,3})\s*(?:through|thru|to|and|-|\x{2013}|\x{2014})\s*([0-9]{1,3})\b"


def ranges_in(text: Column) -> Column:
    """lo, hi of each direction in a text, in order; reversed ones are turned."""
    found = F.regexp_extract_all(text, F.lit(DIRECTION), F.lit(0))
    numbers = F.transform(found, lambda x: F.struct(F.regexp_extract(x, DIRECTION, 1).cast("int").alias("a"), F.regexp_extract(x, DIRECTION, 2).cast("int").alias("b")))
    return F.transform(numbers, lambda n: F.struct(F.least(n["a"], n["b"]).alias("lo"), F.greatest(n["a"], n["b"]).alias("hi")))


@query("instruction_ranges", """
WITH s AS (SELECT l_orderkey AS exam, l_suppkey AS page, CASE l_linenumber % 3 WHEN 0 THEN 'Read it. Answer questions ' || l_linenumber || ' through ' || (1 + l_partkey % 7) || '.' WHEN 1 THEN 'Then do Questions ' || (1 + l_partkey % 7) || '–' || l_linenumber || '; question 9 is open' ELSE 'No direction: 3 to 4.' END AS text FROM lineitem),
r AS (SELECT exam, page, regexp_extract_all(text, '(?i)questions?\\s+([0-9]+)', 1)[1]::INT AS a, coalesce(nullif(regexp_extract(text, '(?:through |–)([0-9]+)', 1), ''), NULL)::INT AS b FROM s WHERE NOT starts_with(text, 'No')),
u AS (SELECT exam, least(a, b) AS lo, greatest(a, b) AS hi, min(page) AS first_page, count(DISTINCT page) AS pages FROM r GROUP BY ALL),
o AS (SELECT *, lag(hi) OVER (PARTITION BY exam ORDER BY lo, hi) AS before FROM u)
SELECT exam, count(*) AS ranges, count(*) FILTER (pages > 1) AS conflicts, count(*) FILTER (before >= lo) AS overlaps, string_agg(lo || '-' || hi, ',' ORDER BY lo, hi) AS named FROM o GROUP BY exam""")
def instruction_ranges(t: Tables) -> DataFrame:
    """Ranges read from each page's directions: how many of an exam, those that begin on different pages, and those that overlap the one before."""
    n, p = F.col("l_linenumber"), F.col("l_partkey") % 7 + 1
    text = F.when(n % 3 == 0, F.format_string("Read it. Answer questions %d through %d.", n, p)).when(n % 3 == 1, F.format_string("Then do Questions %d–%d; question 9 is open", p, n)).otherwise("No direction: 3 to 4.")
    r = t.read("lineitem").select(F.col("l_orderkey").alias("exam"), F.col("l_suppkey").alias("page"), F.explode(ranges_in(text)).alias("r")).select("exam", "page", "r.*")
    u = r.groupBy("exam", "lo", "hi").agg(F.count_distinct("page").alias("pages"))
    o = u.withColumn("before", F.lag("hi").over(Window.partitionBy("exam").orderBy("lo", "hi")))
    named = F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string")))
    return o.groupBy("exam").agg(F.count("*").alias("ranges"), F.count_if(F.col("pages") > 1).alias("conflicts"), F.count_if(F.col("before") >= F.col("lo")).alias("overlaps"), F.array_join(named, ",").alias("named"))


def interval_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """Each point with each range that holds it: lo <= at <= hi, all of them whole numbers. Empty and null ranges hold nothing.

    Both sides are shuffled: statistics don't know that points are multiplied, so Spark
    would collect those of a narrow table on the driver to broadcast them.
    """
    size = F.col(hi) - F.col(lo) + 1
    level = F.ceil(F.length(F.bin(size - 1)) / 3) * 3 * (size > 1).cast("int")  # 2 ** level is the smallest power of eight not below the length
    some = ranges.where(size > 0).withColumn("_level", level.cast("int"))
    block = lambda c: F.call_function("shiftright", F.col(c).cast("bigint"), F.col("_level"))
    dealt = some.withColumn("_block", F.explode(F.array_distinct(F.array(block(lo), block(hi)))))
    levels = [r[0] for r in some.select("_level").distinct().collect()]  # at most 22
    if not levels:
        levels = [0]
    probes = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*(F.lit(x) for x in sorted(levels))))).withColumn("_block", block(at))
    return probes.hint("merge").join(dealt.hint("merge"), ["_level", "_block"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_level", "_block")


RUN = 4096  # rows whose sums are added at a time


def offsets(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows with start: the sum of size over all rows of a smaller key (unique whole numbers).

    Runs of keys are summed first, then the runs' sums, then within each run: no task
    sees all rows.
    """
    run = F.floor(F.col(key) / RUN)
    runs = rows.groupBy(run.alias("_run")).agg(F.sum(size).alias("_sum"))
    top = F.floor(F.col("_run") / RUN)
    tops = runs.groupBy(top.alias("_top")).agg(F.sum("_sum").alias("_top_sum"))
    tops = tops.withColumn("_before", F.sum("_top_sum").over(Window.orderBy("_top")) - F.col("_top_sum")).select("_top", "_before")  # a row for 16 million keys
    within = Window.partitionBy("_top").orderBy("_run")
    runs = runs.withColumn("_top", top).join(tops, "_top").withColumn("_at", F.col("_before") + F.sum("_sum").over(within) - F.col("_sum")).select("_run", "_at")
    own = Window.partitionBy("_run").orderBy(key)
    return rows.withColumn("_run", run).join(runs, "_run").withColumn("start", F.col("_at") + F.sum(size).over(own) - F.col(size)).drop("_run", "_at")


@query("place_in_stream", """
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n FROM documents),
o AS (SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start FROM d),
p AS (SELECT event_id, (event_id * 1000003) % (SELECT greatest(1, sum(n)) FROM d)::BIGINT AS place FROM events)
SELECT event_id, place, doc_id, place - start AS inside FROM p JOIN o ON place >= start AND place <= start + n - 1""")
def place_in_stream(t: Tables) -> DataFrame:
    """For places in the stream of all documents' letters, one for each event: the document that holds it, and where in it."""
    d = t.read("documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    total = d.agg(F.sum("n")).first()[0] or 1
    p = t.read("events").select("event_id", (F.col("event_id") * 1000003 % F.lit(max(1, total))).alias("place"))
    o = offsets(d, "doc_id", "n").withColumn("stop", F.col("start") + F.col("n") - 1)
    return interval_join(p, o, "place", "start", "stop").select("event_id", "place", "doc_id", (F.col("place") - F.col("start")).alias("inside"))
