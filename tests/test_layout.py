import hashlib
import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators.layout import best_markers, centred_clusters
from tallyloom.sources import files


def test_centred_clusters():
    assert centred_clusters([0, 1, 2, 10, 11], 2) == [0, 0, 0, 1, 1]
    assert centred_clusters([], 1) == []


@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), min_size=1, max_size=3), max_size=4))
def test_markers_cost_least(choices):
    path = best_markers(choices)
    ok = [sum(c[i][1] for c, i in zip(choices, p)) for p in itertools.product(*(range(len(c)) for c in choices)) if all(a[i][0] < b[j][0] for (a, i), (b, j) in itertools.pairwise(zip(choices, p)))]
    assert (path is None) == (not ok)
    if path is not None:
        assert sum(c[i][1] for c, i in zip(choices, path)) == min(ok)


def test_documents_with_repeated_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}')
    (tmp_path / "b.json").write_text('{"id": 1, "id": 2}')
    (tmp_path / "c.json").write_text("{")
    got = {r["file"][-6]: (r["doc"] and r["doc"]["id"], r["problem"]) for r in files.read_documents(spark, str(tmp_path), "id int").collect()}
    assert got["a"] == (1, None) and "repeated key: id" in got["b"][1] and got["c"][1]
    assert {r["bytes"] for r in files.digests(spark, str(tmp_path)).collect()} == {9, 18, 1}


def test_publish_and_rollback(spark, tmp_path):
    first, second = spark.range(4), spark.range(7)
    assert files.publish(first, f"{tmp_path}/out", lambda d: d.count() == 4).count() == 4
    with pytest.raises(ValueError):
        files.publish(second, f"{tmp_path}/out", lambda d: False)
    assert files.published(spark, f"{tmp_path}/out").count() == 4  # the failed one is not pointed to
    files.publish(second, f"{tmp_path}/out", lambda d: True)
    assert files.published(spark, f"{tmp_path}/out").count() == 7
    assert files.published(spark, f"{tmp_path}/out", back=1).count() == 4


def test_exports(spark, tmp_path):
    df = spark.range(4).selectExpr("id", "id % 2 as grade", "4 - id as pos")
    files.export(df, f"{tmp_path}/export", "grade")
    before = files.exported(spark, f"{tmp_path}/export")
    assert before.where("grade = 1").count() == 2
    with pytest.raises(Exception, match="disk full"):
        files.export(df.withColumn("id", F.raise_error(F.lit("disk full"))), f"{tmp_path}/export", "grade")
    assert files.exported(spark, f"{tmp_path}/export").count() == 4  # a failed one is not pointed to
    files.export(df.limit(1), f"{tmp_path}/export", "grade")
    assert files.exported(spark, f"{tmp_path}/export").count() == 1 and before.count() == 4  # who reads the old one still does
    files.export_ordered(df, f"{tmp_path}/ordered", ["grade"], ["pos"])
    got = {r["grade"]: [x["id"] for x in r["records"]] for r in files.exported(spark, f"{tmp_path}/ordered").collect()}
    assert got == {0: [2, 0], 1: [3, 1]}


def test_pinned_inventory(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"b": 2,\n "a": [1]}')
    digest = hashlib.sha256(b'{"a":[1],"b":2}').hexdigest()
    assert files.pinned(spark, f"{tmp_path}/i.json", "a array<int>, b int", digest).first()["doc"]["b"] == 2
    with pytest.raises(Exception, match="inventory has digest"):
        files.pinned(spark, f"{tmp_path}/i.json", "a array<int>, b int", "0" * 64).collect()
