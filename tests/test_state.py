"""Assignments, rules and small expressions on cases worked out by hand."""

import datetime as dt
import math
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.calendar import valid_date
from tallyloom.functions import groups
from tallyloom.functions.text import ligatures, re2, repair, unescaped
from tallyloom.operators import cohort, gates, layout, rules, standards, state
from tallyloom.operators.align import earliest, matches, nearest_greedy
from tallyloom.operators.progress import borrows
from tallyloom.operators.state import commit, preflight
from tallyloom.plans import catalog
from tallyloom.sources.bind import VIEWS, Tables

DAY = dt.date(2026, 7, 18)
REQUEST = "request string, day date, module string, track string, confirm boolean, action string, student string"


def tables(spark, sessions=(), tracks=(("ana", "ela"), ("ben", "ela"))):
    return (
        spark.createDataFrame([("ana",), ("ben",)], "student string"), spark.createDataFrame(list(tracks), "student string, track string"),
        spark.createDataFrame([(s, DAY, m) for s, m in sessions], "student string, day date, module string"))


def ask(spark, *students, module="food", track="ela", confirm=False, action=None):
    return spark.createDataFrame([("r", DAY, module, track, confirm, action, s) for s in students], REQUEST)


def run(spark, request, before):
    verdict = preflight(request, *before)
    new_tracks, sessions = commit(request, verdict, *before[1:])
    row = verdict.first()
    return row, {tuple(r) for r in new_tracks.collect()}, {(r["student"], r["module"]) for r in sessions.collect()}


def test_assigns_where_nothing_is_in_the_way(spark):
    row, _, sessions = run(spark, ask(spark, "ana", "ben"), tables(spark))
    assert row["status"] == "assigned" and sessions == {("ana", "food"), ("ben", "food")}


def test_unknown_students(spark):
    row, _, sessions = run(spark, ask(spark, "ana", "zoe"), tables(spark))
    assert row["status"] == "not_found" and row["unknown"] == ["zoe"] and sessions == set()
    row, _, sessions = run(spark, ask(spark, None), tables(spark))
    assert row["status"] == "not_found" and row["unknown"] == [] and sessions == set()


def test_missing_track_needs_a_word(spark):
    state = tables(spark, tracks=[("ana", "ela")])
    row, tracks, sessions = run(spark, ask(spark, "ana", "ben"), state)
    assert row["status"] == "confirmation_required" and row["unenrolled"] == ["ben"] and sessions == set() and ("ben", "ela") not in tracks
    row, tracks, sessions = run(spark, ask(spark, "ana", "ben", confirm=True), state)
    assert row["status"] == "assigned" and ("ben", "ela") in tracks and len(sessions) == 2


def test_collision_replace_and_add(spark):
    state = tables(spark, [("ana", "travel"), ("ben", "food")])
    row, _, sessions = run(spark, ask(spark, "ana", "ben"), state)
    assert row["status"] == "confirmation_required" and row["collisions"] == ["ana"] and sessions == {("ana", "travel"), ("ben", "food")}
    assert run(spark, ask(spark, "ana", action="replace"), state)[2] == {("ana", "food"), ("ben", "food")}
    assert run(spark, ask(spark, "ana", action="add"), state)[2] == {("ana", "food"), ("ana", "travel"), ("ben", "food")}


def test_two_writers_and_a_repeated_request(spark):
    """The first is assigned; the second, judged after it, has to ask; repeating the first changes nothing."""
    state = tables(spark)
    first = ask(spark, "ana")
    verdict = preflight(first, *state)
    new_tracks, sessions = commit(first, verdict, *state[1:])
    later = (state[0], new_tracks, sessions)
    row, _, after = run(spark, ask(spark, "ana", module="travel"), later)
    assert row["status"] == "confirmation_required" and after == {("ana", "food")}
    row, _, after = run(spark, first, later)
    assert row["status"] == "assigned" and after == {("ana", "food")}


def value(spark, column, **literals):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,want", [
    ("see /srv/data/exams/2019.pdf", True), ("C:\\Users here", True), ('href="/a/b/c"', True), ("file:///x", True), ("https://a.org/x/y/z.html", False), ("and/or/not", False), ("1/2", False), ("", False),
])
def test_local_paths(spark, text, want):
    assert value(spark, F.col("x").rlike(rules.PATH), x=text) == want


@pytest.mark.parametrize("text,want", [
    ("Solution: take the root", True), ("the key to the exercises follows", True), ("The right choice is B.", True), ("la respuesta correcta", True), ("a good solution for all", False), ("the piano has a broken key", False),
])
def test_leaks(spark, text, want):
    assert value(spark, F.col("x").rlike(rules.LEAK), x=text) == want


@pytest.mark.parametrize("text,want", [("The correct answer is B.", True), ("As the key says, B", True), ("see the answer key", True), ("La respuesta correcta es C", True), ("The author repeats the word because it matters", False)])
def test_generic_phrases(spark, text, want):
    assert value(spark, F.col("x").rlike(gates.GENERIC), x=text) == want


@pytest.mark.parametrize("text,want", [("2024-02-29", True), ("2023-02-29", False), ("2023-2-9", False), ("x", False), (None, False)])
def test_valid_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(valid_date(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("text,codes", [
    ("ccss.ela-literacy.rl.3.2", [("CCSS.ELA-Literacy.RL.3.2", "key-ideas-details")]), ("CCSS.ELA-Literacy L.6.4C", [("CCSS.ELA-Literacy.L.6.4c", "language-vocabulary")]),
    ("NGLS.ELA.Content.NY-3.R.7", [("NGLS.ELA.Content.NY-3R7", "integration-knowledge")]), ("ngls.ela.content.ny-8r5", [("NGLS.ELA.Content.NY-8R5", "craft-structure")]), ("NGLS.ELA.Content.4L2a", [("NGLS.ELA.Content.4L2a", "language-vocabulary")]),
    ("CCSS.ELA Literacy.SL.5.1, CCSS.ELA\u2013Literacy.W.8.10", [("CCSS.ELA-Literacy.SL.5.1", "other"), ("CCSS.ELA-Literacy.W.8.10", "other")]),
    ("NGLS.ELA.Content.NY\u20147ABC12b; ngls.ela.content.3rl2", [("NGLS.ELA.Content.NY-7ABC12b", "other"), ("NGLS.ELA.Content.3RL2", "key-ideas-details")]),
    ("CCSS.ELA-LiteracyL.6.4c", [("CCSS.ELA-Literacy.L.6.4c", "language-vocabulary")]), ("CCSS.ELA-Literacy.RL.9.1 CCSS.ELA-Literacy.RX.3.1 NGLS.ELA.Content.NY-2R1", []), ("", []),
])
def test_standards(spark, text, codes):
    assert [tuple(c) for c in value(spark, standards.codes_in(F.col("x")), x=text)] == codes


@pytest.mark.parametrize("labels,want", [("ABCDD", "0,1,2,3"), ("AABCD", "0,2,3,4"), ("ABCDABC", "0,1,2,3"), ("ABCDABCD", "4,5,6,7"), ("ABACBDCD", "2,4,6,7"), ("DCBA", None), ("A BxC D", "0,2,4,6"), ("ABBCCDD", "0,1,3,5"), ("", None)])
def test_label_runs(spark, labels, want):
    assert value(spark, layout.last_run(F.split(F.col("x"), "")), x=labels) == want


@settings(max_examples=40, deadline=None)
@given(st.text("ABCD", max_size=14))
def test_label_runs_by_their_definition(spark, labels):
    """After each A the first B, C and D in turn; the run whose D is last, of equal ones the first."""
    runs = []
    for a in (i for i, x in enumerate(labels) if x == "A"):
        run = [a]
        for x in "BCD":
            at = labels.find(x, run[-1] + 1)
            if at < 0:
                break
            run.append(at)
        if len(run) == 4:
            runs.append(run)
    want = max(runs, key=lambda r: (r[3], -r[0]), default=None)
    assert value(spark, layout.last_run(F.split(F.col("x"), "")), x=labels) == (want and ",".join(map(str, want)))


def attempt(spark, tmp, orders, lines):
    spark.createDataFrame(orders, "o_orderkey bigint").write.parquet(f"{tmp}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp}/lineitem.parquet")
    return {r["id"]: (r["status"], r["earned"], r["possible"]) for r in state.exam_score(Tables(spark, str(tmp))).collect()}


def test_exam_score(spark, tmp_path):
    """Order k has 1 + k % 7 questions; question q of it has 1 + (k + q) % 4 points."""
    lines = [(7, 1, 4, 8), (8, 1, 1, 1), (9, 1, 1, 1), (9, 2, 1, 2), (9, 3, 5, 1), (14, 1, 1, 1), (14, 2, 1, 1), (21, 1, 1, 1), (21, 1, 1, 1), (99, 1, 1, 1)]
    got = attempt(spark, tmp_path, [(7,), (8,), (9,), (14,), (21,), (22,)], lines)
    assert got == {7: ("graded", 1, 1), 8: ("incomplete", None, None), 9: ("graded", 4, 8), 14: ("foreign", None, None), 21: ("repeated", None, None), 22: ("incomplete", None, None), 99: ("unknown", None, None)}


def test_repeated_orders_and_missing_keys(spark, tmp_path):
    lines = [(7, 1, 1, 1), (8, 1, 1, 1), (8, 2, 1, 2), (None, 1, 1, 1), (14, None, 1, 1), (14, 1, 1, 1)]
    got = attempt(spark, tmp_path, [(7,), (8,), (8,), (14,), (None,)], lines)
    assert got == {7: ("graded", 1, 1), 8: ("graded", 2 * 2, 2 * 5), 14: ("foreign", None, None), None: ("unknown", None, None)}


def test_parts_grow_with_the_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as o_orderkey", "date'1996-05-05' as o_orderdate", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3000).selectExpr("id % 1000 as l_orderkey", "cast(id div 1000 as int) as l_linenumber", "id as l_partkey", "id as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3000).selectExpr("id as p_partkey", "'PROMO' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    found = []
    for rows in (groups.PART_ROWS, 100):
        monkeypatch.setattr(groups, "PART_ROWS", rows)
        t = Tables(spark, str(tmp_path))
        found.append((sorted(map(tuple, state.exam_score(t).collect())), sorted(map(tuple, standards.catalog_sections(t).collect()))))
    assert found[0] == found[1] and len(found[0][0]) == len(found[0][1]) == 1000
    assert state.exam_score(t).rdd.getNumPartitions() == 40
    assert standards.catalog_sections(t)._jdf.queryExecution().analyzed().toString().count("], 40\n") >= 4


def test_roster_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(k, k % 3, "a") for k in range(40)], "c_custkey bigint, c_nationkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(12)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    t = Tables(spark, str(tmp_path))
    counts = {r["tutor"]: (r["scope"], r["n"], r["first"]) for r in standards.scope_switch(t).collect()}
    for tutor in range(12):
        ids = sorted(r["id"] for r in standards.roster(t, tutor).collect())
        assert ids == [k for k in range(40) if tutor % 10 == 0 or k % 3 == tutor % 3 and k % 7 == tutor % 7]
        assert counts.get(tutor) == (("all" if tutor % 10 == 0 else "assigned", len(ids), ids[0]) if ids else None)
    for name in ("orders", "lineitem", "part", "events"):
        spark.createDataFrame([], "b int, a string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert {tuple(r) for r in standards.table_columns(t).collect()} >= {("part", 2, "a,b"), ("customer", 3, "c_custkey,c_name,c_nationkey")}


def test_every_tutor_has_all_rows_of_their_learners(spark, tmp_path):
    spark.createDataFrame([(k, k % 3) for k in range(120)], "c_custkey bigint, c_nationkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(41)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r["tutor"], r["id"]) for r in standards.scope_switch(Tables(spark, str(tmp_path))).collect())
    assert got == [(t, k) for t in range(41) for k in range(120) if t % 10 == 0 or k % 3 == t % 3 and k % 7 == t % 7]


def test_files_of_every_tutor_and_learner_repeat_runs(spark, tmp_path):
    spark.range(40_000).selectExpr("id * 7919 % 100003 as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1_000).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    standards.scope_switch(Tables(spark, str(tmp_path))).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows >= 100 * 40_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * rows


def test_odd_keys_of_tutors_and_learners(spark, tmp_path, monkeypatch):
    learners = [(k if k % 11 else None, k % 2 if k % 13 else None) for k in range(-20, 700)] + [(21, 1)] * 300
    tutors = [(k if k % 9 else None, k % 2 if k % 8 else None) for k in range(-25, 400)] + [(21, 1), (20, 1)] * 20
    spark.createDataFrame(learners, "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(tutors, "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(standards, "PAIRS", 1000)
    rem = lambda k, n: None if k is None else int(math.fmod(k, n))
    counts = Counter((g, rem(k, 7)) for k, g in learners)
    firsts = {key: min(k for k, g in learners if k is not None and (g, rem(k, 7)) == key) for key in counts if None not in key}
    ids = [k for k, _ in learners]
    every = len(ids), min(k for k in ids if k is not None)
    want = Counter((t, "all", None, None, *every, k) for t, _ in tutors if rem(t, 10) == 0 for k in ids)
    want += Counter((t, "assigned", g, rem(t, 7), counts[g, rem(t, 7)], firsts[g, rem(t, 7)], k) for t, g in tutors if rem(t, 10) for k, h in learners if g is not None and h == g and rem(k, 7) == rem(t, 7))
    assert Counter(map(tuple, standards.scope_switch(Tables(spark, str(tmp_path))).collect())) == want


def test_more_groups_than_any_nation_table(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1500)], "n_nationkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "x"), (2, "y")], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(5, 7)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(5, 1, 50.0), (5, 2, 49.0)], "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in cohort.matrix_gaps(Tables(spark, str(tmp_path))).select("grp", "brand").collect()}
    assert got == {(g, b) for g in range(1500) for b in "xy"} - {(7, "x")}


@pytest.mark.parametrize("a,b,want", [(52, 7, 1), (100, 1, 2), (100, 100, 0), (41, 23, 1), (5, 3, 0), (1000, 999, 3)])
def test_borrows(spark, a, b, want):
    assert value(spark, borrows(F.col("a").cast("bigint"), F.col("b").cast("bigint")), a=a, b=b) == want


def test_text_repairs(spark):
    assert value(spark, ligatures(unescaped("x")), x="&lt;p&gt; &amp;amp; eﬃcient ﬁsh, loﬅ ﬆill") == "<p> &amp; efficient fish, lost still"
    assert repair("ffiisshh") == "fish" and repair("ThThee") == "The" and repair("fifisshh") == "fish" and repair("abba") == "abba"


@given(st.lists(st.integers(0, 9), max_size=8), st.lists(st.integers(0, 9), max_size=8))
def test_nearest_like_a_scan(left, right):
    right = sorted(right)
    free, want = set(range(len(right))), []
    for x in left:
        j = min(free, key=lambda j: (abs(right[j] - x), j), default=-1)
        if j >= 0 and abs(right[j] - x) <= 2:
            free.remove(j)
        else:
            j = -1
        want.append(j)
    assert nearest_greedy(left, right, 2) == want


@given(st.lists(st.sampled_from("abc"), max_size=4), st.lists(st.sampled_from("abc"), max_size=7))
def test_matches_like_all_ways(items, targets):
    from itertools import combinations

    ways = [list(c) for c in combinations(range(len(targets)), len(items)) if [targets[i] for i in c] == items]
    assert matches(items, targets) == ((min(ways), len(ways) > 1) if ways else None)


def test_earliest_match(spark):
    df = spark.createDataFrame([(["a", "b"], "xaxbab"), (["b", "a"], "xa"), ([], "x")], "i array<string>, t string")
    assert [r[0] for r in df.select(earliest(F.col("i"), F.col("t"))).collect()] == [4, -1, 0]


@pytest.mark.parametrize("pattern, text, want", [
    (r"(?i)\bluego\b", "éluego", True), (r"(?i)\bluego\b", "xluego", False), (r"(?i)\bso\b", "ſo", False), (r"(?i)página", "PÁGINA", True), (r"(?i)licen[sc]e", "licenſe", True),
    ("a$", "a\n", False), ("(?m)a$", "a ", False), ("(?m)a$", "b\na\nb", True), ("(?m)^b", "a\rb", False), (r"a\sb", "a\x0bb", False), ("a.b", "a\rb", True), (r"(?i)\.[a-d] \S", ".A x", True),
])
def test_patterns_as_re2_reads_them(spark, pattern, text, want):
    import duckdb

    assert duckdb.connect().execute("SELECT regexp_matches(?, ?)", [text, pattern]).fetchall()[0][0] is want
    assert value(spark, F.col("x").rlike(re2(pattern)), x=text) is want


@pytest.mark.parametrize("name", ["bilingual_gate", "explanation_gate", "text_quality", "page_titles"])
def test_texts_that_java_and_re2_read_apart_as_the_sql(spark, tmp_path, name):
    import duckdb

    texts = ["es verdad éluego", "éporque no", "äso it is", " the answer is ", " " + "word " * 20 + "　", "page 3 ", "la respuesta correcta es b\n", "a weiĺ", None]
    spark.createDataFrame([(k, "es" if k % 2 else None, x) for k, x in enumerate(texts * 2)], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    titles = ["a &amp", "&amp;lt; &#39; &#x27; &copy; ﬁ", "x &lt b &lt; c", ""]
    spark.createDataFrame([(k, "http://a.b/c/d", f'<h1>{x}</h1><a href="e">') for k, x in enumerate(titles)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'").fetchall()
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name].replace(VIEWS, 'none AS (SELECT 1)')})")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_normal_form_holds_few_texts_at_a_time(monkeypatch):
    from tallyloom.functions import text

    sizes = []
    monkeypatch.setattr(text, "normal_form", lambda t: sizes.append(t) or t)
    assert text.nfc.func(pa.array(["a"] * 600)).to_pylist() == ["a"] * 600 and text.nfc.func(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.undo()
    for t in (None, "", "a\nb", "a\tb", "e\u0301\u00ad\ue000x\n", "plain"):
        assert text.normal_form(t) == (None if t is None else "".join(" " if unicodedata.category(c)[0] == "C" and c != "\n" else c for c in unicodedata.normalize("NFC", t)))
