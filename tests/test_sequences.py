"""Sequence algorithms and folds against brute force."""

from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.text import is_doubled, repair
from tallyloom.operators.align import longest_increasing, nearest_greedy
from tallyloom.operators.progress import clamped


def test_increasing_examples():
    assert longest_increasing([48, 1, 2, 3]) == [1, 2, 3]
    assert longest_increasing([1, 50, 2, 3]) == [1, 2, 3]
    assert longest_increasing([5, 1]) == [5]
    assert longest_increasing([]) == []


@given(st.lists(st.integers(0, 9), max_size=9))
def test_increasing_is_longest_and_earliest(xs):
    best = longest_increasing(xs)
    longest = max((k for k in range(len(xs) + 1) for c in combinations(range(len(xs)), k) if all(xs[a] < xs[b] for a, b in zip(c, c[1:]))), default=0)
    first = next((c for c in combinations(range(len(xs)), longest) if all(xs[a] < xs[b] for a, b in zip(c, c[1:]))), ())
    assert best == [xs[i] for i in first]


def test_nearest_uses_each_once():
    assert nearest_greedy([1.0, 1.1, 9.0], [1.2, 0.0, 5.0], 2.0) == [0, 1, -1]


def test_doubled_tokens():
    assert is_doubled("tthhee") and repair("tthhee") == "the"
    assert not is_doubled("the") and not is_doubled("committee")
    assert repair("aabc") == "aabc"


def test_clamped_sums_compose(spark):
    steps = [[7, 7, -12, 7], [-12] * 3 + [7], [7] * 20 + [-12], []]
    df = spark.createDataFrame([(i, s, x) for i, s in enumerate(steps) for x in (0, 3, 50, 100)], "i int, s array<int>, x int")
    f = F.col("f")
    out = df.withColumn("f", clamped(F.col("s"))).select("s", "x", F.least(f["high"], F.greatest(f["low"], F.col("x") + f["add"])).alias("y"))
    for r in out.collect():
        want = r["x"]
        for d in r["s"]:
            want = max(0, min(100, want + d))
        assert r["y"] == want
