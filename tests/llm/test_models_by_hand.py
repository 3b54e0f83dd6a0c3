"""op1 and op7 against plain loops over the same learned weights."""

import math
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest

from tallyloom.llm import language_id, quality

D = "/root/testdata/sf0.01"


def line_by_hand(line, twice):
    """The 17 features of one line, counted letter by letter."""
    data, words = line.encode(), line.split()
    n = len(words)
    count = Counter()
    for c in data:
        ch = chr(c)
        kind = "high" if c > 127 else "lower" if ch.islower() else "upper" if ch.isupper() else "digit" if ch.isdigit() else "space" if ch in " \t\r\x0b\x0c" else "symbol" if c in quality.SYMBOLS else "other"
        count[kind] += 1
        count["stop"] += kind == "other"
    letters = max(1, count["lower"] + count["upper"] + count["high"])
    size = len(data)
    return [
        1, math.log1p(size) / 5, count["upper"] / letters, count["upper"] > 0.5 * letters, count["digit"] / size, count["space"] / size, None, None, None, None, line.count("!") / n,
        math.log1p(n) / 4, min(3, size / n / 6), 1 - len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, twice, line.rstrip()[-1] in ".?!:;\"'",
    ]


def test_features_of_lines():
    lines = ["A line of words.", "THE END!! THE END!!", "x1 x2  x2 é", "again", "again"]
    own, size, counts = quality.line_features(["\n".join(lines), None, " \n"])
    assert counts.tolist() == [5, 0, 0] and size.tolist() == [len(x.encode()) for x in lines]
    for got, line in zip(own, lines):
        for a, b in zip(got, line_by_hand(line, lines.count(line) > 1)):
            assert b is None or a == pytest.approx(float(b), abs=1e-5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_scores_by_enumeration(spark, docs):
    """Every labelling of the lines of short documents, weighed by the field's weights."""
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.op1_quality(spark, D).collect()}
    seen = 0
    for row in docs.collect():
        own, size, counts = quality.line_features([row["text"]])
        n = int(counts[0])
        if not n:
            assert got[row["doc_id"]] == 0.0
        if not 1 <= n <= 6:
            continue
        zero = np.zeros(quality.OWN)
        unary = []
        for k in range(n):
            x = np.concatenate([own[k], own[k - 1] if k else zero, own[k + 1] if k + 1 < n else zero])
            unary.append(float(((x - model.mean) / model.scale) @ model.weights))
        total, good = 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=n):
            p = math.exp(sum(min(30, max(-30, u)) for u, y in zip(unary, labels) if y) + sum(model.trans[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            good += p * np.array(labels)
        mean = float((good / total) @ size / size.sum())
        want = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * mean)))
        assert got[row["doc_id"]] == pytest.approx(want, abs=1e-6)
        seen += 1
    assert seen > 100


def grams_by_hand(text):
    data = b" " + " ".join(text.lower().split()).encode() + b"   "
    count = Counter()
    size = len(data)
    for i in range(size - 3):
        two, three, four = (int.from_bytes(data[i : i + k], "big") for k in (2, 3, 4))
        count[((two ^ 0x51ED0000) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        count[(three * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        if data[i] <= 32 < data[i + 1]:
            count[((four ^ 0x2545F491) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    return count


def test_languages_by_hand(spark, docs):
    rows = docs.collect()
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language_id.op7_language_id(spark, D).collect()}
    langs = sorted({r["lang"] for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2})
    families = sorted({language_id.family(x) for x in langs})
    assert model.langs == langs
    for row in rows:
        out = got[row["doc_id"]]
        assert out["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in row["text"] or ""):
            assert (out["lang_pred"], out["score"]) == ("und", 0.0)
            continue
        count = grams_by_hand(row["text"])
        total = sum(count.values())
        x = {k: math.sqrt(v / total) for k, v in count.items()}
        margins = [w[-1] + sum(w[k] * v for k, v in x.items()) for w in model.weights]
        sure, at = [], 0
        best = families[0]
        if len(families) > 1:
            ranked = sorted(range(len(families)), key=lambda k: -margins[k])
            best, at = families[ranked[0]], len(families)
            sure.append(margins[ranked[0]] - margins[ranked[1]])
        pairs = [p for f in families for p in combinations([v for v in langs if language_id.family(v) == f], 2)]
        votes = {v: [0, 0.0] for v in langs if language_id.family(v) == best}
        for (a, b), m in zip(pairs, margins[at:]):
            if a in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        lang = max(sorted(votes), key=lambda v: votes[v])
        if len(votes) > 1:
            sure.append(votes[lang][1] / (len(votes) - 1) * 2)
        assert out["lang_pred"] == lang and out["score"] == pytest.approx(1 / (1 + math.exp(-2 * min(sure))) if sure else 1.0, abs=1e-4)
