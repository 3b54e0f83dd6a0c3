"""URL verdicts do not depend on the size of the corpus, and ranks are settled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import url_filter


def html(*to):
    return "".join(f'<a href="http://{u}/">x</a>' for u in to)


def test_verdicts_stay_in_a_larger_table(spark):
    rows = [(0, "http://bad.com/de/1", ""), *((i, f"http://linker{i}.net/", html("bad.com")) for i in range(1, 1001))]
    small = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    many = spark.range(2000, 3_002_000, 1, 8).select(F.col("id").alias("page_id"), F.concat(F.lit("http://u"), F.col("id") % 50, F.lit(".com/de/1")).alias("url"), F.lit("").alias("html"))
    got = url_filter.url_verdicts(small.union(many)).where("page_id <= 1000").collect()
    assert len(got) == 1001 and {r["verdict"] for r in got} == {"block"}


def test_chain_and_cycle_settle(spark):
    chain = [(f"h{i}", f"h{i + 1}", 1) for i in range(12)]
    edges = [(a, b, 9) for a, b, _ in chain] + [("h3", "h0", 1), ("h2", "x", 1)]
    names = sorted({v for e in edges for v in e[:2]})
    m = np.zeros((len(names), len(names)))
    for a, b, n in edges:
        m[names.index(b), names.index(a)] = n / sum(e[2] for e in edges if e[0] == a)
    w = np.array([1.0 if v == "h0" else 0.0 for v in names])
    r = w
    for _ in range(500):
        to = 0.85 * m @ r
        r = to + w * (1 - to.sum())
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, links bigint"), spark.createDataFrame([("h0", 1.0)], "host string, weight double"), 0.85, url_filter.SETTLED)
    assert {x["host"]: x["rank"] for x in got.collect()} == {v: pytest.approx(r[i], rel=1e-5) for i, v in enumerate(names)}
