"""Structure found in text and positions: clusters, labels, markers, templates, ledgers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.groups import fold_groups
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

GAP_SECONDS = 3600


@query("row_clusters", f"""
WITH g AS (SELECT user_id, ts::DATE AS day, list(epoch(date_trunc('second', ts))::BIGINT ORDER BY ts) AS tops FROM events GROUP BY ALL),
a AS (SELECT user_id, day, tops, list_reduce(list_transform(tops, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] > {GAP_SECONDS} THEN acc || x ELSE acc END) AS anchors FROM g)
SELECT user_id, day, generate_subscripts(anchors, 1)::INT AS cluster, unnest(anchors) AS top, unnest(list_transform(anchors, lambda x: len(list_filter(tops, lambda y: y >= x AND y <= x + {GAP_SECONDS})))) AS n FROM a""")
def row_clusters(t: Tables) -> DataFrame:
    """Events of a learner's day in rows: one joins a row whose first event is near enough, else it begins a row.

    Times ascend and so do the rows' first ones, so only the newest row can be near.
    """
    e = t.read("events").select("user_id", F.to_date("ts").alias("day"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    g = e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("s")).alias("tops"))
    fresh = lambda acc, x: (F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > GAP_SECONDS)
    g = g.withColumn("anchors", F.aggregate("tops", F.array().cast("array<bigint>"), lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc)))
    rows = g.select("user_id", "day", "tops", F.posexplode("anchors").alias("pos", "top"))
    near = F.filter("tops", lambda y: y.between(F.col("top"), F.col("top") + GAP_SECONDS))
    return rows.select("user_id", "day", (F.col("pos") + 1).alias("cluster"), "top", F.size(near).cast("bigint").alias("n"))


def centred_clusters(xs: list[float], tolerance: float) -> list[int]:
    """Clusters of ascending positions: one joins the last cluster if it is near its mean."""
    out, total, n = [], 0.0, 0
    for x in xs:
        if n and abs(x - total / n) <= tolerance:
            total, n = total + x, n + 1
            out.append(out[-1])
        else:
            total, n = x, 1
            out.append(out[-1] + 1 if out else 0)
    return out


@query("centred_rows")
def centred_rows(t: Tables) -> DataFrame:
    """Lines of an order grouped by nearness of price to the group's moving mean."""
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 1000, 3).alias("y"))

    def fold(rows: list[dict]) -> list[tuple]:
        clusters = centred_clusters([r["y"] for r in rows], 5.0)
        return [(r["l_orderkey"], r["l_linenumber"], c) for r, c in zip(rows, clusters)]

    return fold_groups(lines, ["l_orderkey"], ["y", "l_linenumber"], fold, "l_orderkey bigint, l_linenumber int, cluster int")


LABELS = "ABCD"


@query("label_runs", r"""
WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_extract(x, '^\s*([A-D])', 1)) AS labels FROM documents),
a AS (SELECT doc_id, labels, unnest(list_filter(range(1, len(labels) + 1), lambda i: labels[i] = 'A')) AS a FROM l),
b AS (SELECT *, list_min(list_filter(range(a + 1, len(labels) + 1), lambda i: labels[i] = 'B')) AS b FROM a),
c AS (SELECT *, list_min(list_filter(range(b + 1, len(labels) + 1), lambda i: labels[i] = 'C')) AS c FROM b),
d AS (SELECT *, list_min(list_filter(range(c + 1, len(labels) + 1), lambda i: labels[i] = 'D')) AS d FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, a) AS place FROM d WHERE d IS NOT NULL)
SELECT l.doc_id, CASE WHEN a IS NOT NULL THEN concat_ws(',', a - 1, b - 1, c - 1, d - 1) END AS lines FROM l LEFT JOIN (SELECT * FROM r WHERE place = 1) r ON r.doc_id = l.doc_id""")
def label_runs(t: Tables) -> DataFrame:
    """The run of lines that begin with A, B, C, D whose D comes last, as line numbers from 0; null if there is none.

    After an A the first B counts, after that the first C, then the first D. Runs that
    meet in a later label end with the same D; of these the one of the earliest A is taken.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    labels = F.transform(lines, lambda x: F.regexp_extract(x, rf"^\s*([{LABELS}])", 1))
    return t.read("documents").select("doc_id", last_run(labels).alias("lines"))


def last_run(labels: Column) -> Column:
    """The places of the last run of LABELS in an array of labels, joined by commas; null if there is none. One pass."""
    marked = F.transform(labels, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    none = F.lit(None).cast("string")
    names = [f"after_{x}" for x in LABELS]  # the run that has come as far as this label and waits for the next one
    start = F.struct(*(none.alias(n) for n in names))

    def step(state: Column, at: Column) -> Column:
        out = []
        for k, (name, label) in enumerate(zip(names, LABELS)):
            here = at["x"] == label
            come = F.concat_ws(",", state[names[k - 1]], at["i"].cast("string")) if k else at["i"].cast("string")
            if k:
                come = F.when(state[names[k - 1]].isNotNull(), come)
            if k == len(LABELS) - 1:
                kept = F.when(here, F.coalesce(come, state[name])).otherwise(state[name])  # a later end replaces an earlier one
            else:
                kept = F.when(here, F.coalesce(state[name], come)).when(at["x"] == LABELS[k + 1], None).otherwise(state[name])
            out.append(kept.alias(name))
        return F.struct(*out)

    return F.aggregate(marked, start, step)[names[-1]]


def best_markers(choices: list[list[tuple[float, float]]]) -> list[int] | None:
    """One (position, cost) from each list, positions strictly ascending, least total cost; earliest on ties."""
    if not choices:
        return []
    best = [[(cost, [i]) for i, (_, cost) in enumerate(choices[0])]]
    for before, now in zip(choices, choices[1:]):
        row = []
        for i, (at, cost) in enumerate(now):
            ok = [(c, path) for (c, path), (prior, _) in zip(best[-1], before) if prior < at and path]
            row.append((min(ok)[0] + cost, min(ok)[1] + [i]) if ok else (float("inf"), []))
        best.append(row)
    cost, path = min(((c, p) for c, p in best[-1] if p), default=(0, None))
    return path


@query("marker_choice")
def marker_choice(t: Tables) -> DataFrame:
    """For each short order, one candidate of every line with ascending ship dates at least cost."""
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", F.unix_date(F.to_date("l_shipdate")).alias("at"), F.round("l_discount", 2).alias("cost"))

    def fold(rows: list[dict]) -> list[tuple]:
        choices: dict[int, list] = {}
        for r in rows:
            choices.setdefault(r["l_linenumber"], []).append((r["at"], r["cost"]))
        path = best_markers(list(choices.values()))
        return [(rows[0]["l_orderkey"], len(choices), None if path is None else ",".join(map(str, path)))]

    return fold_groups(lines, ["l_orderkey"], ["l_linenumber", "at", "cost"], fold, "id bigint, lines int, path string")


@query("choice_parse", r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?m)^([A-Z])[a-z]+ ', 1) AS labels, regexp_extract(coalesce(text, ''), '^([^\n.]*)', 1) AS stem FROM documents)
SELECT doc_id, stem, len(labels)::INT AS choices, array_to_string(labels[1:4], '') AS first4, len(list_distinct(labels)) = len(labels) AS once, array_to_string(labels, '') = array_to_string(list_sort(labels), '') AS ordered FROM c""")
def choice_parse(t: Tables) -> DataFrame:
    """Stem and line labels of each document; whether labels are in order and occur once."""
    text = F.coalesce("text", F.lit(""))
    c = t.read("documents").select("doc_id", F.regexp_extract_all(text, F.lit("(?m)^([A-Z])[a-z]+ "), F.lit(1)).alias("labels"), F.regexp_extract(text, r"^([^\n.]*)", 1).alias("stem"))
    return c.select("doc_id", "stem", F.size("labels").alias("choices"), F.array_join(F.slice("labels", 1, 4), "").alias("first4"),
                    (F.size(F.array_distinct("labels")) == F.size("labels")).alias("once"), (F.array_sort("labels") == F.col("labels")).alias("ordered"))


@query("template_expand", """
WITH t AS (SELECT * FROM (VALUES ('BUILDING', 'Build %s'), ('MACHINERY', 'Run %s'), ('HOUSEHOLD', 'Keep %s')) v(track, form))
SELECT id, replace(form, '%s', name) || ' (group ' || grp || ')' AS title FROM learners JOIN t USING (track)""")
def template_expand(t: Tables) -> DataFrame:
    """Titles from a small table of templates by track."""
    forms = t.spark.createDataFrame([("BUILDING", "Build %s"), ("MACHINERY", "Run %s"), ("HOUSEHOLD", "Keep %s")], "track string, form string")
    title = F.concat(F.replace("form", F.lit("%s"), F.col("name")), F.lit(" (group "), F.col("grp").cast("string"), F.lit(")"))
    return t.learners.join(F.broadcast(forms), "track").select("id", title.alias("title"))  # three rows


@query("ledger_check", """
WITH r AS (SELECT conv_id AS id, turn, sha256(lower(regexp_extract(coalesce(text, ''), '^\\s*(\\S+)', 1))) AS hash FROM conversations),
d AS (SELECT hash, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first FROM r GROUP BY hash)
SELECT hash, n, ids, first FROM d WHERE n > 1""")
def ledger_check(t: Tables) -> DataFrame:
    """Records that are not unique by the digest of their first word, with how many and where first."""
    first = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(\S+)", 1))
    r = t.read("conversations").select(F.col("conv_id").alias("id"), F.sha2(first, 256).alias("hash"))
    return r.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first")).where("n > 1")


@query("source_counts", """
SELECT source, lang, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) <> n_chars) AS wrong_length FROM documents GROUP BY ALL""")
def source_counts(t: Tables) -> DataFrame:
    """Provenance counts, and declared lengths that don't hold."""
    d = t.read("documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_length"))


def exchanges(t: Tables) -> DataFrame:
    """Each question with the turn that follows it: conv_id, turn, a, b."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    c = t.read("conversations").select("conv_id", "turn", "role", text.alias("a"), F.lead(text).over(w).alias("b"))
    return c.where("role = 'user' and b is not null").select("conv_id", "turn", "a", "b")


RATIO = 0.72  # likeness from which a boundary is carried over


@query("boundary_projection")
def boundary_projection(t: Tables) -> DataFrame:
    """Where the end of a question falls in the answer, by aligned words; null where the two aren't alike enough."""
    from difflib import SequenceMatcher

    @F.pandas_udf("end int, whole boolean")
    def project(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        def one(x, y):
            m = SequenceMatcher(None, x.split(), y.split(), autojunk=False)
            last = [k for k in m.get_matching_blocks() if k.size][-1:]
            return (last[0].b + last[0].size if last else -1, m.ratio() >= RATIO)

        rows = [one(x, y) for x, y in zip(a, b)]
        return pd.DataFrame({"end": pd.Series([r[0] for r in rows], dtype="int32"), "whole": pd.Series([r[1] for r in rows], dtype=bool)})

    p = exchanges(t).select("conv_id", "turn", project("a", "b").alias("p"))
    return p.select("conv_id", "turn", F.col("p.end").alias("end"), F.when(F.col("p.whole"), F.col("p.end")).alias("boundary"))
