"""Codes of standards, catalog order, ranges of questions, and checks of single fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.calendar import valid_date
from tallyloom.functions.groups import parts_of
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

#: Sections of a catalog in the order in which they are shown.
SECTIONS = ("PROMO", "SMALL", "MEDIUM", "LARGE", "STANDARD", "ECONOMY", "OTHER")
#: How the two frameworks begin, strands of the first one, skills, and the anchor numbers that part them.
BEGINS = "CCSS.ELA-LITERACY", "NGLS.ELA.CONTENT"
STRANDS = ("RL", "RI", "L", "W", "SL")
LANGUAGE, READING = "language-vocabulary", ((3, "key-ideas-details"), (6, "craft-structure"), (10**9, "integration-knowledge"))
#: What may be a code: the beginning of a framework and what hangs on to it, as far as a number.
LOOSE = r"(?i)\b(?:CCSS\.ELA-Literacy|NGLS\.ELA\.Content)[. ]?[A-Z0-9.-]*[0-9]+[a-z]?"
FORMS = ("CCSS.ELA-Literacy.RL.%s.%s", "ccss.ela-literacy l.%s.%sA", "NGLS.ELA.Content.NY-%sR%s", "ngls.ela.content.ny-%s.l.%sB", "CCSS.ELA Literacy.SL.%s.%s", "NGLS.ELA.Content.NY–%sSL.%sc", "CCSS.ELA—Literacy.X.%s.%s")


def codes_in(text: Column) -> Column:
    """code, skill of each standard in a text, in their order.

    A code is cut into runs of letters and of digits. Framework A has strand, grade,
    number and perhaps a letter; framework B perhaps NY, then grade, strand, number and
    perhaps a letter. What doesn't fit is none.
    """
    one = F.replace(F.translate(text, "–—", "--"), F.lit("ELA Literacy"), F.lit("ELA-Literacy"))
    runs = F.transform(F.regexp_extract_all(one, F.lit(LOOSE), F.lit(0)), lambda c: F.struct(
        F.upper(c).startswith(BEGINS[0]).alias("a"), F.regexp_extract_all(F.regexp_replace(F.upper(c), "^(" + "|".join(BEGINS).replace(".", r"\.") + ")", ""), F.lit("[A-Z]+|[0-9]+"), F.lit(0)).alias("w")))
    state = lambda r: ~r["a"] & (F.get(r["w"], F.lit(0)) == "NY")
    runs = F.transform(runs, lambda r: F.struct(r["a"].alias("a"), state(r).alias("ny"), F.when(state(r), F.slice(r["w"], 2, 4)).otherwise(r["w"]).alias("w")))
    at = lambda r, k: F.get(r["w"], F.lit(k))
    fields = F.transform(runs, lambda r: F.struct(
        r["a"].alias("a"), r["ny"].alias("ny"), F.when(r["a"], at(r, 0)).otherwise(at(r, 1)).alias("strand"), F.when(r["a"], at(r, 1)).otherwise(at(r, 0)).alias("grade"), at(r, 2).alias("number"),
        F.when(at(r, 3).rlike("^[A-Z]$"), F.lower(at(r, 3))).otherwise("").alias("letter")))
    good = F.filter(fields, lambda f: F.coalesce(f["grade"].rlike("^[3-8]$") & f["number"].rlike("^[0-9]+$") & F.when(f["a"], f["strand"].isin(*STRANDS)).otherwise(f["strand"].rlike("^[A-Z]{1,3}$")), F.lit(False)))

    def skill(f: Column) -> Column:
        found = F.when(f["strand"] == "L", LANGUAGE)
        for most, name in READING:
            found = found.when(f["strand"].isin("R", "RL", "RI") & (f["number"].cast("decimal(20,0)") <= most), name)
        return found.otherwise("other")

    return F.transform(good, lambda f: F.struct(
        F.when(f["a"], F.concat(F.lit("CCSS.ELA-Literacy."), f["strand"], F.lit("."), f["grade"], F.lit("."), f["number"], f["letter"])).otherwise(
            F.concat(F.lit("NGLS.ELA.Content."), F.when(f["ny"], "NY-").otherwise(""), f["grade"], f["strand"], f["number"], f["letter"])).alias("code"), skill(f).alias("skill")))


@query("standard_codes", rf"""
WITH p AS (SELECT p_partkey AS id, p_name, p_partkey % 6 + 3 AS g, p_size % 9 + 1 AS n FROM part),
x AS (SELECT id, p_name || ': ' || CASE id % 4 WHEN 0 THEN 'CCSS.ELA-Literacy.RL.' || g || '.' || n WHEN 1 THEN 'ccss.ela-literacy l.' || g || '.' || n || 'A' WHEN 2 THEN 'NGLS.ELA.Content.NY-' || g || 'R' || n ELSE 'ngls.ela.content.ny-' || g || '.l.' || n || 'B' END
                 || '; CCSS.ELA-Literacy.RL.' || g || '.' || n || ', ngls.ela.content.ny-' || g || '.l.' || n || 'B (CCSS.ELA Literacy.SL.' || g || '.' || n || ', NGLS.ELA.Content.NY–' || g || 'SL.' || n || 'c; CCSS.ELA—Literacy.X.' || g || '.' || n || ')' AS text FROM p),
y AS (SELECT id, regexp_extract_all(replace(replace(replace(text, '–', '-'), '—', '-'), 'ELA Literacy', 'ELA-Literacy'), '{LOOSE}') AS c FROM x),
c AS (SELECT id, unnest(c) AS code, generate_subscripts(c, 1) AS pos FROM y),
f AS (SELECT id, pos, left(upper(code), 4) = 'CCSS' AS a, regexp_extract_all(regexp_replace(upper(code), '^(CCSS\.ELA-LITERACY|NGLS\.ELA\.CONTENT)', ''), '[A-Z]+|[0-9]+') AS w FROM c),
g AS (SELECT id, pos, a, NOT a AND w[1] = 'NY' AS ny, CASE WHEN NOT a AND w[1] = 'NY' THEN w[2:] ELSE w END AS v FROM f),
h AS (SELECT id, pos, a, ny, CASE WHEN a THEN v[1] ELSE v[2] END AS strand, CASE WHEN a THEN v[2] ELSE v[1] END AS grade, v[3] AS number, CASE WHEN regexp_matches(v[4], '^[A-Z]$') THEN lower(v[4]) ELSE '' END AS letter FROM g),
k AS (SELECT id, pos, CASE WHEN a THEN 'CCSS.ELA-Literacy.' || strand || '.' || grade || '.' || number || letter ELSE 'NGLS.ELA.Content.' || CASE WHEN ny THEN 'NY-' ELSE '' END || grade || strand || number || letter END AS code,
             CASE WHEN strand = 'L' THEN 'language-vocabulary' WHEN strand NOT IN ('R', 'RL', 'RI') THEN 'other' WHEN number::INT <= 3 THEN 'key-ideas-details' WHEN number::INT <= 6 THEN 'craft-structure' ELSE 'integration-knowledge' END AS skill
      FROM h WHERE regexp_matches(grade, '^[3-8]$') AND regexp_matches(number, '^[0-9]+$') AND CASE WHEN a THEN strand IN {STRANDS} ELSE regexp_matches(strand, '^[A-Z]{{1,3}}$') END),
s AS (SELECT id, code, min(pos) AS pos, min(skill) AS skill FROM k GROUP BY id, code)
SELECT id, string_agg(code, ',' ORDER BY pos) AS standards, string_agg(skill, ',' ORDER BY pos) AS skills FROM s GROUP BY id""")
def standard_codes(t: Tables) -> DataFrame:
    """The distinct standards in a text, in their first order, in one spelling, and the skill of each."""
    grade, n = F.col("p_partkey") % 6 + 3, F.col("p_size") % 9 + 1
    form = lambda k: F.format_string(FORMS[k], grade, n)
    first = F.when(F.col("p_partkey") % 4 == 0, form(0)).when(F.col("p_partkey") % 4 == 1, form(1)).when(F.col("p_partkey") % 4 == 2, form(2)).otherwise(form(3))
    text = F.concat("p_name", F.lit(": "), first, F.lit("; "), form(0), F.lit(", "), form(3), F.lit(" ("), form(4), F.lit(", "), form(5), F.lit("; "), form(6), F.lit(")"))
    p = t.read("part").select(F.col("p_partkey").alias("id"), F.array_distinct(codes_in(text)).alias("c"))
    return p.select("id", F.array_join("c.code", ",").alias("standards"), F.array_join("c.skill", ",").alias("skills"))


@query("standards_match", """
WITH a AS (SELECT p_partkey AS id, p_size % 6 AS grade, p_partkey % 6 AS domain, p_size % 5 AS number, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 4 END AS sub FROM part),
m AS (SELECT s_suppkey % 6 AS grade, (s_suppkey // 6) % 6 AS domain, s_nationkey % 5 AS number, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 4 END AS sub FROM supplier)
SELECT id, count(*) AS n FROM a JOIN m ON a.grade = m.grade AND a.domain = m.domain AND a.number = m.number AND (a.sub IS NULL OR m.sub IS NULL OR a.sub = m.sub) GROUP BY id""")
def standards_match(t: Tables) -> DataFrame:
    """How many mapped standards fit each item: equal parts, where a missing last part fits any. Both sides are counted by signature first."""
    sub = lambda c: F.when(F.col(c) % 3 > 0, F.col(c) % 4)
    part, size = F.col("p_partkey"), F.col("p_size")
    a = t.read("part").select(part.alias("id"), (size % 6).alias("grade"), (part % 6).alias("domain"), (size % 5).alias("number"), sub("p_partkey").alias("sub"))
    s = F.col("s_suppkey")
    m = t.read("supplier").groupBy((s % 6).alias("grade"), (F.floor(s / 6) % 6).alias("domain"), (F.col("s_nationkey") % 5).alias("number"), sub("s_suppkey").alias("mapped")).agg(F.count("*").alias("m"))
    fits = F.col("sub").isNull() | F.col("mapped").isNull() | (F.col("sub") == F.col("mapped"))
    kinds = a.select("grade", "domain", "number", "sub").distinct().join(m, ["grade", "domain", "number"]).where(fits).groupBy("grade", "domain", "number", "sub").agg(F.sum("m").alias("n"))
    both = [a[c] == kinds[c] for c in ("grade", "domain", "number")] + [a["sub"].eqNullSafe(kinds["sub"])]
    return a.join(kinds, both).select("id", "n")


@query("catalog_sections", """
WITH q AS (SELECT l_orderkey AS exam, l_partkey AS part, CASE WHEN p_type = 'STANDARD' AND year(o_orderdate) = 1996 THEN 'OTHER' ELSE p_type END AS domain, year(o_orderdate)::INT AS year, o_custkey % 6 + 3 AS grade
           FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
d AS (SELECT name, i::INT AS pos FROM (SELECT unnest(['PROMO', 'SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'ECONOMY', 'OTHER']) AS name, generate_series AS i FROM generate_series(1, 7) LIMIT 0) UNION ALL
      SELECT * FROM (VALUES ('PROMO', 1), ('SMALL', 2), ('MEDIUM', 3), ('LARGE', 4), ('STANDARD', 5), ('ECONOMY', 6), ('OTHER', 7)) v(name, pos)),
s AS (SELECT exam, year, grade, pos, domain, count(*) AS n FROM q JOIN d ON name = domain GROUP BY ALL),
r AS (SELECT year, grade, row_number() OVER (ORDER BY year DESC, grade) AS shelf FROM (SELECT DISTINCT year, grade FROM s))
SELECT year, grade, exam, string_agg(domain || ':' || n, ',' ORDER BY pos) AS sections, shelf FROM s JOIN r USING (year, grade) GROUP BY year, grade, exam, shelf""")
def catalog_sections(t: Tables) -> DataFrame:
    """Exams with their sections in a fixed order, only those that have questions; one domain is moved in one year.

    shelf orders the catalog: later years first, then grades. Only the distinct years and
    grades are ordered, never all exams of one.
    """
    order = F.array(*map(F.lit, SECTIONS))
    p = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    o = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 6 + 3).alias("grade"))
    lines = t.read("lineitem").select("l_orderkey", "l_partkey")
    n = parts_of(lines, o)
    deal = lambda rows, by: rows.repartition(n, by)
    q = deal(deal(lines, "l_partkey").join(deal(p, "l_partkey"), "l_partkey"), "l_orderkey").join(deal(o, "l_orderkey"), "l_orderkey")
    domain = F.when((F.col("p_type") == "STANDARD") & (F.col("year") == 1996), "OTHER").otherwise(F.col("p_type"))
    s = q.groupBy("year", "grade", F.col("l_orderkey").alias("exam"), domain.alias("domain")).agg(F.count("*").alias("n"))
    s = s.withColumn("pos", F.array_position(order, F.col("domain"))).where("pos > 0")
    g = s.groupBy("year", "grade", "exam").agg(F.sort_array(F.collect_list(F.struct("pos", "domain", "n"))).alias("s"))
    shelves = g.select("year", "grade").distinct().withColumn("shelf", F.row_number().over(Window.orderBy(F.desc("year"), "grade")).cast("bigint"))
    sections = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["domain"], x["n"].cast("string"))), ",")
    return g.join(shelves, ["year", "grade"]).select("year", "grade", "exam", sections.alias("sections"), "shelf")


@query("stimulus_ranges", """
WITH r AS (SELECT l_orderkey AS exam, least(l_linenumber, 1 + l_partkey % 7) AS lo, greatest(l_linenumber, 1 + l_partkey % 7) AS hi, l_suppkey AS page FROM lineitem),
u AS (SELECT exam, lo, hi, min(page) AS first_page, count(DISTINCT page) AS pages FROM r GROUP BY ALL),
o AS (SELECT *, lag(hi) OVER (PARTITION BY exam ORDER BY lo, hi) AS before FROM u)
SELECT exam, count(*) AS ranges, sum(hi - lo + 1)::BIGINT AS covered, count(*) FILTER (pages > 1) AS conflicts, count(*) FILTER (before >= lo) AS overlaps, min(first_page) - 1 AS before_first FROM o GROUP BY exam""")
def stimulus_ranges(t: Tables) -> DataFrame:
    """Ranges of questions put in order, once each: how many they cover, conflicting first pages, overlaps, and the page before the first."""
    a, b = F.col("l_linenumber"), (F.col("l_partkey") % 7 + 1).cast("int")
    r = t.read("lineitem").select(F.col("l_orderkey").alias("exam"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col("l_suppkey").alias("page"))
    u = r.groupBy("exam", "lo", "hi").agg(F.min("page").alias("first_page"), F.count_distinct("page").alias("pages"))
    o = u.withColumn("before", F.lag("hi").over(Window.partitionBy("exam").orderBy("lo", "hi")))
    return o.groupBy("exam").agg(
        F.count("*").alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"), F.count_if(F.col("pages") > 1).alias("conflicts"), F.count_if(F.col("before") >= F.col("lo")).alias("overlaps"),
        (F.min("first_page") - 1).alias("before_first"))


@query("one_stimulus", """
WITH b AS (SELECT n_nationkey AS grp, i AS band, -1000 + i * 2500 AS lo, -1000 + (i + 1) * 2750 AS hi FROM nation, (SELECT unnest(range(4)) AS i))
SELECT c_custkey AS id, count(grp) AS n, CASE WHEN count(grp) = 1 THEN min(band)::INT END AS band FROM customer LEFT JOIN b ON grp = c_nationkey AND c_acctbal BETWEEN lo AND hi GROUP BY c_custkey""")
def one_stimulus(t: Tables) -> DataFrame:
    """The band in which each learner's balance lies where it is exactly one; how many it is. Bands overlap; groups have four each."""
    bands = t.read("nation").select(F.col("n_nationkey").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band"))
    bands = bands.withColumns({"lo": -1000 + F.col("band") * 2500.0, "hi": -1000 + (F.col("band") + 1) * 2750.0}).groupBy("grp").agg(F.collect_list(F.struct("band", "lo", "hi")).alias("bands"))
    c = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("x")).join(bands, "grp", "left")
    fits = F.filter("bands", lambda b: F.col("x").between(b["lo"], b["hi"]))
    c = c.select("id", F.coalesce(fits, F.array().cast("array<struct<band:int,lo:double,hi:double>>")).alias("fits"))
    return c.select("id", F.size("fits").cast("bigint").alias("n"), F.when(F.size("fits") == 1, F.get("fits", F.lit(0))["band"]).alias("band"))


@query("profile_fields", r"""
SELECT c_custkey AS id, lower(trim('  ' || c_name || '@Example.COM ')) AS email, regexp_matches(lower(trim(c_name || CASE WHEN c_custkey % 4 = 0 THEN '@@x' ELSE '@example.com' END)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email_ok,
       length(c_name) BETWEEN 2 AND 80 AND NOT regexp_matches(c_name || CASE WHEN c_custkey % 5 = 0 THEN chr(7) ELSE '' END, '\p{Cc}') AS name_ok, regexp_matches(right(c_name, 3 + (c_custkey % 3)::INT), '^[0-9]{4}$') AS pin_ok,
       CASE WHEN upper(trim(' ' || chr(97 + (c_custkey % 6)::INT) || ' ')) IN ('A', 'B', 'C', 'D') THEN upper(chr(97 + (c_custkey % 6)::INT)) END AS choice,
       'draft:' || replace(replace(url_encode(c_name || ' ' || c_mktsegment || '/é'), '+', '%20'), '%23', '%23') AS draft_key, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Nombre ' || c_name END AS title,
       (c_name = 'Customer#000000007' AND c_mktsegment = 'BUILDING') OR (c_name = 'Customer#000000011' AND c_nationkey > 3) OR c_custkey % 100 = 1 AS listed, CASE WHEN c_nationkey BETWEEN 3 AND 8 THEN c_nationkey END AS grade
FROM customer""")
def profile_fields(t: Tables) -> DataFrame:
    """Normalised and checked fields: e-mail, name, PIN, choice, storage key, localised title, membership in a list of pairs, grade."""
    key, name = F.col("c_custkey"), F.col("c_name")
    address = F.lower(F.trim(F.concat(name, F.when(key % 4 == 0, "@@x").otherwise("@example.com"))))
    control = F.concat(name, F.when(key % 5 == 0, F.char(F.lit(7))).otherwise("")).rlike(r"\p{Cc}")
    letter = F.upper(F.trim(F.concat(F.lit(" "), F.char(key % 6 + 97), F.lit(" "))))
    encoded = F.replace(F.url_encode(F.concat_ws("", name, F.lit(" "), "c_mktsegment", F.lit("/é"))), F.lit("+"), F.lit("%20"))
    pair = ((name == "Customer#000000007") & (F.col("c_mktsegment") == "BUILDING")) | ((name == "Customer#000000011") & (F.col("c_nationkey") > 3)) | (key % 100 == 1)
    text = F.struct(name.alias("en"), F.concat(F.lit("Nombre "), name).alias("es"))
    return t.read("customer").select(
        key.alias("id"), F.lower(F.trim(F.concat(F.lit("  "), name, F.lit("@Example.COM ")))).alias("email"), address.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$").alias("email_ok"), (F.length(name).between(2, 80) & ~control).alias("name_ok"),
        F.right(name, (key % 3 + 3).cast("int")).rlike("^[0-9]{4}$").alias("pin_ok"), F.when(letter.isin("A", "B", "C", "D"), letter).alias("choice"), F.concat(F.lit("draft:"), encoded).alias("draft_key"),
        F.when(key % 2 == 0, text["en"]).otherwise(text["es"]).alias("title"), pair.alias("listed"), F.when(F.col("c_nationkey").between(3, 8), F.col("c_nationkey")).alias("grade"))


@query("date_fields", """
WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-02-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-31') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS text, 'Last Updated: ' || strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS line FROM orders)
SELECT id, text, coalesce(strftime(try_strptime(text, '%Y-%m-%d'), '%Y-%m-%d') = text, false) AS valid, strftime(strptime(regexp_extract(line, '([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})', 1), '%B %-d, %Y'), '%Y-%m-%d') AS updated FROM d""")
def date_fields(t: Tables) -> DataFrame:
    """Whether a text is a real date, and the date of a line that names its month."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(day, "yyyy-'02'-dd")).when(key % 4 == 2, F.date_format(day, "yyyy-MM-'31'")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    line = F.concat(F.lit("Last Updated: "), F.date_format(day, "MMMM d, yyyy"))
    d = t.read("orders").select(key.alias("id"), text.alias("text"), F.regexp_extract(line, "([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1).alias("named"))
    return d.select("id", "text", valid_date(F.col("text")).alias("valid"), F.date_format(F.to_date("named", "MMMM d, yyyy"), "yyyy-MM-dd").alias("updated"))


@query("table_facts", """
SELECT 'learners' AS name, count(*) AS n, coalesce(bool_or(c_acctbal > 9900), false) AS any_rich, sum(c_nationkey)::BIGINT AS total FROM customer
UNION ALL SELECT 'attempts', count(*), coalesce(bool_or(o_totalprice > 499000), false), sum(o_custkey)::BIGINT FROM orders
UNION ALL SELECT 'items', count(*), coalesce(bool_or(p_size > 50), false), sum(p_size)::BIGINT FROM part""")
def table_facts(t: Tables) -> DataFrame:
    """Numbers of rows, whether any row is of a kind, and totals."""
    parts = [("learners", "customer", F.col("c_acctbal") > 9900, "c_nationkey"), ("attempts", "orders", F.col("o_totalprice") > 499000, "o_custkey"), ("items", "part", F.col("p_size") > 50, "p_size")]
    there = {name: not t.read(table).where(any_).isEmpty() for name, table, any_, _ in parts}  # ends at the first such row
    rows = [t.read(table).agg(F.count("*").alias("n"), F.sum(c).alias("total")).select(F.lit(name).alias("name"), "n", F.lit(there[name]).alias("any_rich"), "total") for name, table, _, c in parts]
    return reduce(DataFrame.union, rows)


COLUMN_TABLES = ("customer", "orders", "lineitem", "part", "events")


@query("table_columns", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS columns, string_agg(column_name, ',' ORDER BY column_name) AS names FROM (DESCRIBE {name})" for name in COLUMN_TABLES))
def table_columns(t: Tables) -> DataFrame:
    """Columns of the tables, from their schemas alone, so that a table without rows has its row too."""
    columns = {name: sorted(t.read(name).columns) for name in COLUMN_TABLES}
    return t.spark.createDataFrame([(name, len(c), ",".join(c)) for name, c in columns.items()], "name string, columns bigint, names string")


@query("skill_maps", """
WITH s AS (SELECT user_id, skill, count(*) AS n, count(*) FILTER (ok) / count(*) AS share FROM answers WHERE skill IN ('click', 'purchase', 'view') GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS answers, string_agg(skill || '=' || n, ',' ORDER BY skill) AS counts, round(max(CASE WHEN share = 0 AND skill = 'click' THEN 0.3 ELSE greatest(0, least(1, share)) END), 6)::DOUBLE AS best FROM s GROUP BY user_id""")
def skill_maps(t: Tables) -> DataFrame:
    """Counts of known skills as a map: sum of its values, its entries; and the best share right, where an untouched first skill has a floor of 0.3."""
    g = t.answers.groupBy("user_id", "skill").agg(F.count("*").alias("n"), (F.count_if("ok") / F.count("*")).alias("share"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("skill", F.struct("n", "share").alias("v")))).alias("m"))
    known = F.map_filter("m", lambda k, _: k.isin("click", "purchase", "view"))
    m = m.select("user_id", known.alias("m")).where(F.size("m") > 0)
    n = F.transform_values("m", lambda _, v: v["n"])
    share = F.transform_values("m", lambda k, v: F.when((v["share"] == 0) & (k == "click"), F.lit(0.3)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["share"]))))
    entries = F.sort_array(F.transform(F.map_entries(n), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return m.select("user_id", F.aggregate(F.map_values(n), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("answers"), F.array_join(entries, ",").alias("counts"), F.round(F.array_max(F.map_values(share)), 6).alias("best"))


@query("track_counts", """
WITH l AS (SELECT c_nationkey AS grp, list_filter([CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'ESL' END], lambda x: x IS NOT NULL) AS tracks FROM customer),
d AS (SELECT DISTINCT c_mktsegment AS track FROM customer UNION SELECT unnest(['ESL', 'NONE'])), n AS (SELECT track, count(*) AS n FROM (SELECT unnest(tracks) AS track FROM l) GROUP BY track)
SELECT track, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (track)""")
def track_counts(t: Tables) -> DataFrame:
    """Learners by track from an array column, tracks without any as zero."""
    key = F.col("c_custkey")
    c = t.read("customer")
    tracks = F.array_compact(F.array(F.when(key % 2 == 0, F.col("c_mktsegment")), F.when(key % 3 == 0, "ESL")))
    n = c.select(F.explode(tracks).alias("track")).groupBy("track").agg(F.count("*").alias("n"))
    domain = c.select(F.col("c_mktsegment").alias("track")).distinct().union(t.spark.createDataFrame([("ESL",), ("NONE",)], "track string")).distinct()
    return domain.join(n, "track", "left").select("track", F.coalesce("n", F.lit(0)).alias("n"))


@query("set_verdicts", """
WITH a AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey % 3)) AS have FROM lineitem GROUP BY l_orderkey)
SELECT id, have = [0, 1, 2] AS equal, array_to_string(list_sort(list_filter([0, 1, 2], lambda x: NOT list_contains(have, x))), ',') AS lacking FROM a""")
def set_verdicts(t: Tables) -> DataFrame:
    """Whether a document's set is exactly the expected one, and what it lacks."""
    want = F.array(*(F.lit(k).cast("bigint") for k in range(3)))
    a = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey") % 3).alias("have"))
    equal = (F.size(F.array_except(want, "have")) == 0) & (F.size(F.array_except("have", want)) == 0)
    return a.select("id", equal.alias("equal"), F.array_join(F.sort_array(F.array_except(want, "have")).cast("array<string>"), ",").alias("lacking"))


@query("scope_switch", """
WITH g AS (SELECT c_nationkey AS grp, c_custkey % 7 AS shift, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL)
SELECT s_suppkey AS tutor, 'assigned' AS scope, grp, shift, n, first, c_custkey AS id FROM supplier JOIN g ON grp = s_nationkey AND shift = s_suppkey % 7 JOIN customer ON c_nationkey = grp AND c_custkey % 7 = shift WHERE s_suppkey % 10 <> 0
UNION ALL SELECT s_suppkey, 'all', NULL, NULL, (SELECT count(*) FROM customer), (SELECT min(c_custkey) FROM customer), c_custkey FROM supplier CROSS JOIN customer WHERE s_suppkey % 10 = 0""")
def scope_switch(t: Tables) -> DataFrame:
    """Each learner that a tutor sees (those of the group and shift assigned to them, or all), with how many they are and the first.

    Every tutor has all of their rows, so their number grows with tutors times learners;
    what is shuffled grows with tutors plus learners. Runs of tutors meet runs of learners
    and only then become rows, a whole run of learners for each tutor: columnar files hold
    a run that comes again as a reference to the one before, not as its ids.
    """
    c = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), (F.col("c_custkey") % 7).alias("shift"))
    s = t.read("supplier").select(F.col("s_suppkey").alias("tutor"), F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") % 7).alias("shift"))
    n = F.count("*").alias("n"), F.min("id").alias("first")
    columns = "scope", "grp", "shift", "n", "first", "tutors", "ids"

    # a group's learners are dealt out by cell too, so that a large group is not one task
    at, parts = ["grp", "shift", "cell"], parts_of(c)
    cell = F.pmod(F.xxhash64("near"), F.lit(CELLS)).cast("int").alias("cell")
    learners = near(c, 32_768).select("*", cell).where("grp is not null and shift is not null").repartition(parts, *at)
    counted = near(s.where("tutor % 10 <> 0"), 32_768).join(c.groupBy("grp", "shift").agg(*n), ["grp", "shift"])
    tutors = runs(counted, "tutor", ["grp", "shift", "n", "first", "near"], TUTORS).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))).repartition(parts, *at)
    assigned = runs(learners, "id", [*at, "near"], LEARNERS).join(tutors.drop("near").hint("shuffle_hash"), at).withColumn("scope", F.lit("assigned")).select(*columns)

    # each part of all learners meets each part of these tutors: no table is collected anywhere, or written again for each part of the other
    c, s = c.select("id"), s.where("tutor % 10 = 0").select("tutor")
    n_learners, n_tutors = c.count(), s.count()
    few = 1 + n_tutors // 65_536
    parts = max(t.spark.sparkContext.defaultParallelism, min(n_learners // 1024, n_learners * n_tutors // (few * PAIRS)))
    tutors = runs(near(s, 4096), "tutor", ["near"], TUTORS).drop("near").coalesce(few).crossJoin(F.broadcast(c.agg(*n)))  # one row
    every = runs(near(c, 1024).repartition(parts, "near"), "id", ["near"], LEARNERS).drop("near").crossJoin(tutors.hint("shuffle_replicate_nl"))
    none = F.lit(None).cast("bigint")
    every = every.withColumns({"scope": F.lit("all"), "grp": none, "shift": none}).select(*columns)

    # rows are made after the union: a join in the same generated code would first hold all rows that one of its own gives
    return assigned.unionByName(every).withColumn("tutor", F.explode("tutors")).withColumn("id", F.explode("ids")).select("tutor", *columns[:5], "id")


TUTORS, LEARNERS = 16, 256  # of a run
CELLS = 16  # of a group's learners
PAIRS = 100_000_000  # rows that a task makes where all are seen


def near(df: DataFrame, rows: int) -> DataFrame:
    """df with a number that at most so many rows share, which lie together in the table.

    df has to be read straight from files, so that a repeated task finds the same order.
    """
    return df.withColumn("near", F.floor(F.monotonically_increasing_id() / rows))


def runs(df: DataFrame, who: str, keys: list[str], most: int) -> DataFrame:
    """Arrays (who, with an s) of at most so many values, nulls too, of rows with the same keys."""
    run = df.groupBy(*keys).agg(F.collect_list(F.struct(who)).alias("run"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("run"), F.lit(most)), lambda k: F.slice("run", k, most))
    return run.select(*keys, F.explode(pieces).alias("run")).select(*keys, F.col("run")[who].alias(f"{who}s"))


def roster(t: Tables, tutor: int) -> DataFrame:
    """id of each learner whom one tutor sees."""
    c = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), (F.col("c_custkey") % 7).alias("shift"))
    if tutor % 10 == 0:
        return c.select("id")
    own = t.read("supplier").where(F.col("s_suppkey") == tutor).select(F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") % 7).alias("shift"))
    return c.join(own, ["grp", "shift"], "left_semi").select("id")


@query("keyed_lookup", """
SELECT l_orderkey AS id, l_linenumber AS number, p_name AS name FROM lineitem JOIN part ON l_suppkey % 7 || ':' || l_partkey = p_partkey % 7 || ':' || p_partkey""")
def keyed_lookup(t: Tables) -> DataFrame:
    """Content found by a compound key."""
    p = t.read("part").select(F.concat_ws(":", F.col("p_partkey") % 7, "p_partkey").alias("key"), F.col("p_name").alias("name"))
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("number"), F.concat_ws(":", F.col("l_suppkey") % 7, "l_partkey").alias("key"))
    return lines.join(p, "key").select("id", "number", "name")


@query("pair_membership", """
SELECT o_orderkey AS id FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F') AND o_orderstatus <> 'F'""")
def pair_membership(t: Tables) -> DataFrame:
    """Open attempts of a learner and kind that also have a finished one."""
    o = t.read("orders")
    done = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct()
    return o.where("o_orderstatus <> 'F'").join(done, ["o_custkey", "o_orderpriority"], "left_semi").select(F.col("o_orderkey").alias("id"))


@query("provenance", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), d AS (SELECT source, sum(n)::BIGINT AS n, string_agg(lang, ',' ORDER BY lang) AS langs FROM c GROUP BY source)
SELECT source, n, langs, langs = 'de,en,es,fr' AND n >= 10 AS expected FROM d""")
def provenance(t: Tables) -> DataFrame:
    """Documents by source with the distinct languages in order, and whether both are as declared."""
    c = t.read("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    d = c.groupBy("source").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    return d.select("source", "n", "langs", ((F.col("langs") == DECLARED[0]) & (F.col("n") >= DECLARED[1])).alias("expected"))


#: What each source is declared to hold: its languages, and how many documents at least.
DECLARED = "de,en,es,fr", 10


@query("most_missed", """
SELECT skill, k, count(*) AS missed FROM answers WHERE NOT ok AND k IS NOT NULL GROUP BY ALL ORDER BY missed DESC, skill, k LIMIT 5""")
def most_missed(t: Tables) -> DataFrame:
    """The five most missed questions."""
    return t.answers.where("not ok and k is not null").groupBy("skill", "k").agg(F.count("*").alias("missed")).orderBy(F.desc("missed"), "skill", "k").limit(5)
