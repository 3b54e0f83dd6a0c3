"""Sequence algorithms within small groups: nearest match, increasing runs, alignment.

Groups are a learner's day or one conversation, so each fits a task; every algorithm
sees its group once, in order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyloom.functions.groups import fold_groups
from tallyloom.operators.layout import exchanges
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables


def nearest_greedy(left: list[float], right: list[float], tolerance: float) -> list[int]:
    """For each of left in order the nearest free one of right (ascending) within tolerance, ties by position; else -1.

    Taken ones are skipped by links to the next free one on either side.
    """
    n = len(right)
    up, down = list(range(n + 1)), list(range(n + 1))  # next free at or after i; at or before i - 1, as i

    def find(link: list[int], i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    out = []
    for x in left:
        at = bisect_left(right, x)
        after, before = find(up, at), find(down, at) - 1
        best = -1
        if before >= 0 and abs(right[before] - x) <= tolerance:
            best = before
            first = bisect_left(right, right[before])  # equal ones: the first free
            best = find(up, first)
        if after < n and abs(right[after] - x) <= tolerance and (best < 0 or abs(right[after] - x) < abs(right[best] - x)):
            best = after
        if best >= 0:
            up[best], down[best + 1] = best + 1, best
        out.append(best)
    return out


def longest_increasing(xs: list[int]) -> list[int]:
    """The longest strictly increasing subsequence; of several the one that starts earliest at each step."""
    n, tails = len(xs), []
    length = [0] * n  # of the longest one that begins at i
    for i in range(n - 1, -1, -1):
        at = bisect_left(tails, -xs[i])
        tails[at : at + 1] = [-xs[i]]
        length[i] = at + 1
    out, last, need = [], None, max(length, default=0)
    for i, x in enumerate(xs):
        if need and length[i] == need and (last is None or x > last):
            out.append(x)
            last, need = x, need - 1
    return out


@query("nearest_link")
def nearest_link(t: Tables) -> DataFrame:
    """Each purchase with the nearest unused view of the same learner and day, within two hours."""
    e = t.read("events").where(F.col("event_type").isin("purchase", "view")).select("user_id", F.to_date("ts").alias("day"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")

    def fold(rows: list[dict]) -> list[tuple]:
        bought, seen = ([r for r in rows if r["event_type"] == kind] for kind in ("purchase", "view"))
        to = nearest_greedy([r["us"] for r in bought], [r["us"] for r in seen], 7.2e9)
        return [(r["user_id"], r["event_id"], seen[j]["event_id"] if j >= 0 else None) for r, j in zip(bought, to)]

    return fold_groups(e, ["user_id", "day"], ["us", "event_id"], fold, "user_id bigint, purchase bigint, view bigint")


@query("lis_markers")
def lis_markers(t: Tables) -> DataFrame:
    """The longest increasing run of question numbers of each learner's day."""
    rows = t.answers.where("k is not null").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "k")

    def fold(rows: list[dict]) -> list[tuple]:
        xs = longest_increasing([r["k"] for r in rows])
        return [(rows[0]["user_id"], rows[0]["day"], len(xs), ",".join(map(str, xs)))]

    return fold_groups(rows, ["user_id", "day"], ["ts", "event_id"], fold, "user_id bigint, day date, length int, run string")


@query("monotone_align", r"""
WITH w AS (SELECT conv_id, turn, role, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
x AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(a), '(?m)^[\p{L}]'), lambda x: unicode(x)) AS items, array_to_string(regexp_extract_all(lower(b), '[\p{L}]+'), ' ') AS words FROM w WHERE role = 'user' AND b IS NOT NULL),
t AS (SELECT conv_id, turn, items, array_to_string(list_transform(string_split(words, ' '), lambda x: left(x, 1)), '') AS letters FROM x),
f AS (SELECT *, list_reduce(list_prepend(0, items), lambda p, c: CASE WHEN p < 0 OR instr(substr(letters, p + 1), chr(c)) = 0 THEN -1 ELSE p + instr(substr(letters, p + 1), chr(c))::INT END) AS first_end,
       list_reduce(list_prepend(0, list_reverse(items)), lambda p, c: CASE WHEN p < 0 OR instr(substr(reverse(letters), p + 1), chr(c)) = 0 THEN -1 ELSE p + instr(substr(reverse(letters), p + 1), chr(c))::INT END) AS back FROM t)
SELECT conv_id, turn, len(items)::INT AS items, first_end >= 0 AS aligned, CASE WHEN first_end > 0 THEN first_end - 1 END AS last_target, CASE WHEN first_end > 0 THEN length(letters)::INT - list_reduce(list_prepend(0, list_reverse(items)), lambda p, c: CASE WHEN p < 0 OR instr(substr(reverse(letters), p + 1), chr(c)) = 0 THEN -1 ELSE p + instr(substr(reverse(letters), p + 1), chr(c))::INT END) END AS latest_first FROM f""")
def monotone_align(t: Tables) -> DataFrame:
    """First letters of a question's lines matched in order, all of them, with the first letters of the answer's words.

    The earliest match is taken: last_target is where its last letter lands, latest_first
    where the first letter lands in the latest match. matches() tells whether the two differ.
    """
    q = exchanges(t).select("conv_id", "turn", F.regexp_extract_all(F.lower("a"), F.lit(r"(?m)^[\p{L}]"), F.lit(0)).alias("items"), F.regexp_extract_all(F.lower("b"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("words"))
    q = q.withColumn("letters", F.array_join(F.transform("words", lambda x: F.left(x, F.lit(1))), ""))
    matched = q.select("conv_id", "turn", F.size("items").alias("n"), "letters", earliest(F.col("items"), F.col("letters")).alias("end"), earliest(F.reverse("items"), F.reverse("letters")).alias("back"))
    hit = F.col("end") > 0
    return matched.select("conv_id", "turn", F.col("n").alias("items"), (F.col("end") >= 0).alias("aligned"), F.when(hit, F.col("end") - 1).alias("last_target"), F.when(hit, F.length("letters") - F.col("back")).alias("latest_first"))


def earliest(items: Column, letters: Column) -> Column:
    """Where the earliest order-preserving match of all items (letters) ends, counted from 1; -1 if not all can be matched, 0 for none."""
    def step(p, c):
        rest = F.instr(F.substring(letters, p + 1, F.length(letters)), c)
        return F.when((p < 0) | (rest == 0), F.lit(-1)).otherwise(p + rest)

    return F.aggregate(items, F.lit(0), step)


def matches(items: list[str], targets: list[str], fits=lambda a, b: a == b) -> tuple[list[int], bool] | None:
    """The earliest order-preserving match of all items, and whether there is another one; None if not all can be matched.

    A match is the only one if the earliest and the latest one are the same.
    """
    def walk(a: list[str], b: list[str]) -> list[int] | None:
        out, at = [], 0
        for x in a:
            while at < len(b) and not fits(x, b[at]):
                at += 1
            if at == len(b):
                return None
            out.append(at)
            at += 1
        return out

    first, last = walk(items, targets), walk(items[::-1], targets[::-1])
    if first is None or last is None:
        return None
    return first, first != [len(targets) - 1 - j for j in reversed(last)]


@query("standards_align")
def standards_align(t: Tables) -> DataFrame:
    """The items of a learner's last attempt of a year aligned with the whole list of the year, by domain: the places, and whether they are ambiguous.

    The list holds the items, so they can always be placed; map_align aligns two tables.
    """
    p = t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("domain"))
    o = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("year"))
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey").join(p, "l_partkey")

    def fold(rows: list[dict]) -> list[tuple]:
        targets = [r["domain"] for r in rows]
        last = max(r["l_orderkey"] for r in rows)
        items = [r["domain"] for r in rows if r["l_orderkey"] == last]
        found = matches(items, targets)
        return [(rows[0]["user_id"], rows[0]["year"], ",".join(map(str, found[0])), found[1])]

    return fold_groups(lines, ["user_id", "year"], ["l_orderkey", "l_linenumber", "l_partkey"], fold, "user_id bigint, year int, places string, ambiguous boolean")


def compatible(item: tuple, mapped: tuple) -> bool:
    """Whether two signatures (parts, last part) agree; a missing last part fits any."""
    return item[:-1] == mapped[:-1] and (item[-1] is None or mapped[-1] is None or item[-1] == mapped[-1])


@query("map_align")
def map_align(t: Tables) -> DataFrame:
    """All items of each attempt aligned, in order, with the learner's map: where each lands, or that it can't be done.

    The map is the learner's events in time; an item and an event have a domain and a last
    part that may be missing and then fits any. An attempt is failed, ambiguous (there is
    another way; the earliest is given) or aligned.
    """
    sub = lambda c, k: F.when(c % k > 0, c % 2)
    sign = lambda c, k: ((F.coalesce(c % 17, F.lit(17)) + 17) * 3 + F.coalesce(sub(F.floor(c / 17), k) + 1, F.lit(0))).cast("int")  # noqa: E731  17: no domain, which no map has
    o = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    row = F.struct("l_linenumber", "l_partkey", sign(F.col("l_partkey"), 3).alias("sign"))
    items = t.read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row))["sign"].alias("items")).join(o, "l_orderkey")
    k = F.coalesce("k", F.lit(0)).cast("bigint")
    mapped = t.answers.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", sign(k, 4).alias("sign"))))["sign"].alias("map"))
    rows = items.groupBy("user_id").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("attempt"), "items")).alias("attempts")).join(mapped, "user_id", "left")
    schema = "user_id bigint, attempt bigint, items int, status string, places string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for user, attempts, targets in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    found = Places(targets or [])
                    for a in attempts:
                        own = a["items"]
                        first = found.earliest(own)
                        status = "failed" if first is None else "ambiguous" if first != found.latest(own) else "aligned"
                        out.append((user, a["attempt"], len(own), status, first and ",".join(map(str, first))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)

    return rows.select("user_id", "attempts", "map").mapInArrow(run, schema)


class Places:
    """Where the signs of a list stand, so that a match takes a look-up for each item and not a walk.

    A sign is 3 * domain + 0 for a missing last part, or + 1 or + 2 for one; see compatible().
    """

    def __init__(self, targets: list[int]):
        self.at: dict[int, list[int]] = {}
        for j, x in enumerate(targets):
            low = x - x % 3
            for sign in (low, low + 1, low + 2) if x == low else (low, x):
                self.at.setdefault(sign, []).append(j)

    def earliest(self, items: list[int]) -> list[int] | None:
        """The places of the earliest match of all items in order; None if there is none."""
        out, after = [], 0
        for x in items:
            places = self.at.get(x, ())
            k = bisect_left(places, after)
            if k == len(places):
                return None
            out.append(places[k])
            after = places[k] + 1
        return out

    def latest(self, items: list[int]) -> list[int]:
        """The places of the latest match, where there is one."""
        out, before = [], math.inf
        for x in reversed(items):
            places = self.at[x]
            before = places[bisect_left(places, before) - 1]
            out.append(before)
        return out[::-1]


@query("fuzzy_ratio")
def fuzzy_ratio(t: Tables) -> DataFrame:
    """Likeness (matching blocks) of every question and the turn after it, by words."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio(), 6) for x, y in zip(a, b)], dtype=float)

    return exchanges(t).select("conv_id", "turn", ratio("a", "b").alias("ratio"))
