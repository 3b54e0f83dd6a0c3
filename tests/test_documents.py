"""The document source, joint publishing, phrases, ranges, leaves and assertions."""

import json
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import leaves, ledger, phrases, ranges
from tallyloom.sources import files
from tallyloom.sources.documents import CheckedJson, canonical

D = "/root/testdata/sf0.001"
BAD = ['{"a": 1, "a": 2}', "{", "", "NaN", '{"b": {"x": 1, "x": 1}}', "[" * 100_000]


def load(spark, path, **options):
    spark.dataSource.register(CheckedJson)
    return spark.read.format("checked_json").options(**options).load(str(path))


def test_documents_of_a_column(spark, tmp_path):
    """Several files and row groups; bad documents are rows, null ones are none."""
    good = ['{"b": 2, "a": [1, {"ü": null}]}', "7", '"x"']
    texts = good + BAD + [None]
    for part in range(2):
        pq.write_table(pa.table({"id": [100 * part + i for i in range(len(texts))], "props": texts, "x": [0] * len(texts)}), tmp_path / f"{part}.parquet", row_group_size=4)
    got = {int(r["key"]): (r["doc"], r["problem"]) for r in load(spark, tmp_path, column="props", key="id").collect()}
    assert sorted(got) == [100 * p + i for p in range(2) for i in range(len(texts) - 1)]
    for i, text in enumerate(texts[:-1]):
        doc, problem = got[100 + i]
        assert (doc is None) == (i >= len(good)) and (problem is None) == (i < len(good))
        if doc:
            assert json.loads(doc) == json.loads(text) and " " not in doc
    assert got[0][0] == '{"a":[1,{"ü":null}],"b":2}' and "repeated key: a" in got[3][1] and "repeated key: x" in got[7][1]


def test_fail_fast_and_whole_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1}')
    (tmp_path / "in" / "b.json").write_text(BAD[0])
    assert sorted((r["key"][-6:], r["doc"]) for r in load(spark, tmp_path / "in").collect()) == [("a.json", '{"id":1}'), ("b.json", None)]
    with pytest.raises(Exception, match="repeated key: a"):
        load(spark, tmp_path / "in", mode="failfast").collect()
    (tmp_path / "in" / "b.json").unlink()
    assert load(spark, f"file://{tmp_path}/in", mode="FAILFAST").count() == 1
    with pytest.raises(Exception, match="partial or failfast"):
        load(spark, tmp_path / "in", mode="permissive").collect()
    with pytest.raises(Exception, match="nothing"):
        load(spark, tmp_path / "nothing").collect()


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_canonical_keeps_the_value(value):
    doc, problem = canonical(json.dumps(value))
    assert problem is None and json.loads(doc) == value


def counts(tables):
    return {name: df.count() for name, df in tables.items()}


def test_tables_are_published_together(spark, tmp_path):
    path = f"{tmp_path}/out"
    tables = lambda n: {"catalog": spark.range(n), "assets": spark.range(10 * n).selectExpr("id", "'x' as name")}
    assert counts(files.publish_together(tables(2), path, lambda t: t["assets"].count() == 20)) == {"catalog": 2, "assets": 20}
    with pytest.raises(ValueError, match="there is no version before"):
        files.roll_back_together(spark, path)
    with pytest.raises(ValueError, match="not published"):
        files.publish_together(tables(3), path, lambda t: t["catalog"].count() == 4)
    # the second write fails after the first one is done
    broken = {"catalog": spark.range(5), "assets": spark.range(5).select(F.raise_error(F.lit("disk full")).cast("string").alias("name"))}
    with pytest.raises(Exception, match="disk full"):
        files.publish_together(broken, path, lambda t: True)
    assert counts(files.published_together(spark, path)) == {"catalog": 2, "assets": 20}
    files.publish_together(tables(7), path, lambda t: True)
    assert counts(files.published_together(spark, path)) == {"catalog": 7, "assets": 70}
    assert counts(files.roll_back_together(spark, path)) == counts(files.published_together(spark, path)) == {"catalog": 2, "assets": 20}


@pytest.mark.parametrize("block", [3, 1000])
def test_phrases_like_a_search_for_each(spark, block):
    """Also of many phrases in several automata; overlaps, prefixes and repeated phrases."""
    r = random.Random(block)
    listed = [(k, "".join(r.choice("ab ") for _ in range(r.randrange(1, 5)))) for k in range(40)] + [(40, "é日"), (41, ""), (42, None)]
    texts = [(k, "".join(r.choice("ab é日") for _ in range(60))) for k in range(50)] + [(50, None), (51, "")]
    got = {(x["id"], x["phrase_id"]): x["n"] for x in phrases.phrase_counts(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(listed, "phrase_id int, phrase string"), block).collect()}
    want = {(i, k): len(re.findall(f"(?={re.escape(p)})", t)) for i, t in texts if t for k, p in listed if p and p in t}
    assert got == want


def test_phrases_equal_patterns_on_all_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    some = [r["text"][k : k + n] for r in docs.where("length(text) > 60").limit(12).collect() for k, n in ((0, 6), (9, 4), (20, 2), (30, 12))]
    listed = list(enumerate(sorted(set(some))))
    got = {(r["id"], r["phrase_id"]) for r in phrases.phrase_counts(docs, spark.createDataFrame(listed, "phrase_id int, phrase string")).collect()}
    found = docs.select("id", *(F.col("text").rlike(re.sub(r"([^\w\s])", r"\\\1", p)).alias(f"p{k}") for k, p in listed)).collect()
    assert got == {(r["id"], k) for r in found for k, _ in listed if r[f"p{k}"]} and len(got) > len(listed)


@pytest.mark.parametrize("text, want", [
    ("1 one\n2 two\n3 three ", "length,words"), ("1 one\n3 two\n4 three", "length,words,marks_differ"), ("“It is,’ he said.\n1 a\n2 b\n3 c", "length,words,closing"),
    ("he went t he way\n1 a\n2 b\n3 c", "length,words,split_word"), ("[A drawing of a house]\n1 a\n2 b\n3 c", "length,words,visuals"), ("", "length,words,private_glyph,few_marks"),
])
def test_review_rules(spark, text, want):
    docs = spark.createDataFrame([(1, text.strip(), None)], "doc_id int, text string, corrupt boolean")
    assert phrases.review(docs).first()["violations"] == want


def test_review_with_expected_numbers(spark):
    docs = spark.createDataFrame([(1, "4 a\n7 b\n9 c\n[A drawing of a house]", True)], "doc_id int, text string, corrupt boolean")
    assert phrases.review(docs, F.array(F.lit(4), F.lit(7), F.lit(9)), 1).first()["violations"] == "length,words,corrupt"


@pytest.mark.parametrize("text, want", [
    ("Read this. Then answer questions 5 through 9.", [(5, 9)]), ("Questions 12 – 7 and question 3 to 3", [(7, 12), (3, 3)]), ("questions 1-2; questions 2—4", [(1, 2), (2, 4)]), ("5 through 9", []), ("", []),
])
def test_ranges_in_text(spark, text, want):
    assert [tuple(r) for r in spark.createDataFrame([(text,)], "x string").select(ranges.ranges_in(F.col("x"))).first()[0]] == want


def test_interval_join_like_a_nested_loop(spark):
    r = random.Random(4)
    span = [(k, lo := r.randrange(-300, 300), lo + r.choice([-1, 0, 0, 1, 5, 31, 32, 33, 500])) for k in range(120)] + [(120, None, 4), (121, 4, None), (122, -(2**40), 2**40)]
    at = [(k, r.randrange(-320, 820)) for k in range(150)] + [(150, None)]
    got = ranges.interval_join(spark.createDataFrame(at, "p int, x bigint"), spark.createDataFrame(span, "k int, lo bigint, hi bigint"), "x", "lo", "hi")
    assert sorted((g["p"], g["k"]) for g in got.collect()) == sorted((p, k) for p, x in at for k, lo, hi in span if None not in (x, lo, hi) and lo <= x <= hi)
    assert ranges.interval_join(got.select("p", "x"), spark.createDataFrame([], "k int, lo bigint, hi bigint"), "x", "lo", "hi").count() == 0


def test_multiplied_points_are_not_broadcast(spark):
    points, spans = spark.range(1000).select(F.col("id").alias("x")), spark.range(0, 1000, 10).select("id", F.col("id").alias("lo"), (F.col("id") + 9 + F.col("id") % 7 * 50).alias("hi"))
    got = ranges.interval_join(points, spans, "x", "lo", "hi")
    assert got.count() == sum(lo <= x <= lo + 9 + lo % 7 * 50 for x in range(1000) for lo in range(0, 1000, 10))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_offsets_of_sparse_keys(spark):
    r = random.Random(6)
    rows = [(key, r.randrange(0, 9)) for key in r.sample(range(0, 4096 * 4096 * 3, 1013), 300)]
    want, total = {}, 0
    for key, n in sorted(rows):
        want[key], total = total, total + n
    assert {x["k"]: x["start"] for x in ranges.offsets(spark.createDataFrame(rows, "k bigint, n bigint"), "k", "n").collect()} == want


def walked(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield f'{path}["{k}"]#', str(k)
            yield from walked(v, f'{path}["{k}"]')
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, f"{path}[{i}]")
    elif isinstance(value, tuple):
        for name, v in zip(value._fields, value):
            yield from walked(v, f"{path}.{name}" if path else name)
    elif value is not None:
        yield path, str(value)


def test_leaves_of_nested_values(spark):
    from collections import namedtuple

    deep, top = namedtuple("deep", "n m"), namedtuple("top", "a b c d")
    value = top([deep(1, {"k": ["x", None], "l": None}), None, deep(None, {})], "t", {7: deep(2, {"z": []})}, None)
    schema = "v struct<a: array<struct<n: int, m: map<string, array<string>>>>, b: string, c: map<int, struct<n: int, m: map<string, array<string>>>>, d: array<array<int>>>"
    df = spark.createDataFrame([(value,), (None,)], schema)
    got = [sorted((x["path"], x["value"]) for x in r[0]) for r in df.select(leaves.leaves(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [sorted(walked(value)), []]


def test_leaf_violations(spark):
    df = spark.createDataFrame([(1, {"mail a@b.org": "/home/me/x"}, ["ok", "token=abc"])], "id int, m map<string,string>, l array<string>")
    got = {(r["path"], r["code"]) for r in leaves.leaf_violations(df, ["id"], leaves.RULES).collect()}
    assert got == {('m["mail a@b.org"]#', "email"), ('m["mail a@b.org"]', "path"), ("l[1]", "secret")}


@pytest.mark.parametrize("wrong", [None, 0, 4095, 4096, 9000])
def test_order_across_borders(spark, tmp_path, wrong):
    """A single row that comes too late is found wherever it stands, also at the border of two runs."""
    keys = list(range(10, 10_010))
    if wrong is not None:
        keys[wrong], keys[wrong + 1] = keys[wrong + 1], keys[wrong]
    pq.write_table(pa.table({"k": keys}), tmp_path / "t.parquet", row_group_size=1000)
    row = ledger.is_sorted(spark.read.parquet(f"{tmp_path}/t.parquet"), "k", "t").first()
    assert tuple(row) == ("t", "sorted", wrong is None, int(wrong is not None), None if wrong is None else str(keys[wrong + 1]))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 4) | st.none(), max_size=8), st.lists(st.integers(0, 4), max_size=6))
def test_sets_and_repeats(spark, have, want):
    a, b = spark.createDataFrame([(x,) for x in have], "k int"), spark.createDataFrame([(x,) for x in want], "w int")
    unique = ledger.is_unique(a, ["k"], "u").first()
    assert unique["violations"] == sum(have.count(x) > 1 for x in set(have)) and unique["holds"] == (len(set(have)) == len(have))
    exact = ledger.is_exact_set(a.where("k is not null"), "k", b, "w", "e").first()
    assert exact["violations"] == len({x for x in have if x is not None} ^ set(want))


def test_both_verdicts_occur_on_the_tables(spark):
    from tallyloom.plans import catalog

    rows = catalog.QUERIES["ledger_assertions"](spark, D).collect()
    assert {(r["kind"], r["holds"]) for r in rows} == {(k, v) for k in ("sorted", "exact set", "total", "unique") for v in (True, False)}
