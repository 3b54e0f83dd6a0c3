"""Line deduplication, whitening and spelling variants against plain loops, and their defined results."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import line_dedup, registry, spelling, whitening
from tallyloom.llm.common import table
from tests.llm.helpers import HARD, documents

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# lines


def plain_lines(rows, least_chars=20, least_docs=3):
    """(doc_id, text) -> list of (doc_id, n_lines, n_dropped, kept text); a null id is below all others."""
    low = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[lowered(line.strip(WHITE))].add(low(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [lowered(line.strip(WHITE)) for line in lines]
        keep = [line for line, k in zip(lines, keys) if len(k) < least_chars or len(holders[k]) < least_docs or low(i) == max(holders[k])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def got_lines(docs, **more):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, **more).collect()]


def line_texts(seed, n):
    r = random.Random(seed)
    common = [f"{'Common' if k % 2 else 'cOMMON'} line number {k} of them all é" for k in range(12)] + ["short", "", "  ", "exactly twenty chars", "nineteen characters"]
    texts = []
    for _ in range(n):
        lines = [r.choice(common) if r.random() < 0.7 else f"a line of its own, {r.random()}" for _ in range(r.randrange(0, 14))]
        texts.append("\n".join(r.choice(["", " ", "\t"]) + x + r.choice(["", "\r", "  "]) for x in lines))
    return texts


@pytest.mark.parametrize("rows", [1, 40, 4_000_000])
def test_lines_by_plain_loop(spark, rows):
    """Also with so many ranges that one line's rows fill several of them."""
    texts = line_texts(rows, 150) + ["the hot line that all of them hold\n" * 3] * 60
    docs = documents(spark, texts)
    assert sorted(got_lines(docs, rows=rows)) == sorted(plain_lines(list(enumerate(texts))))


def test_lines_of_hard_rows(spark):
    again = "this line stands in many rows\nand this one in as many"
    rows = [(i, t) for i, t in enumerate(HARD)] + [(7, again), (7, again), (7, again + "\n"), (8, again), (None, again), (None, again), (3, "x\n" + again)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda r: (r[0] is None, str(r))
    assert sorted(got_lines(docs), key=key) == sorted(plain_lines(rows), key=key)
    assert got_lines(docs.limit(0)) == []


def test_lines_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5)], "doc_id bigint, text string, kept_text string, n_lines int")
    assert line_dedup.dedup_lines(docs).collect()[0].asDict() == {"doc_id": 1, "text": "a", "kept_text": "x", "n_lines": 5, "kept_text_": "a", "n_lines_": 1, "n_dropped": 0}


def test_lines_with_string_ids(spark):
    rows = [(f"d{k}", f"this line stands in every document\nown line of document {k}") for k in range(9)]
    assert sorted(got_lines(spark.createDataFrame(rows, "doc_id string, text string"))) == [(i, 2, int(i != "d8"), t if i == "d8" else t.split("\n")[1]) for i, t in rows]


def test_bitmaps_are_returned_not_texts(spark):
    texts = ["common line of twenty and more\nown line " + "é" * 30 + str(k) for k in range(5)]
    found = {r["doc_id"]: r["keep"] for r in line_dedup.keep_bitmaps(documents(spark, texts)).collect()}
    assert found.keys() == {0, 1, 2, 3}
    assert all(line_dedup.kept_lines(t.encode().split(b"\n"), found.get(k)) == t.encode().split(b"\n")[k < 4 :] for k, t in enumerate(texts))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1), st.integers(0, 400))
def test_bitmap(gone, n):
    lines = [str(k).encode() for k in range(n)]
    kept = line_dedup.kept_lines(lines, line_dedup.bitmap(np.array(sorted(gone))))
    assert kept == [x for k, x in enumerate(lines) if k not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 2)), max_size=40), st.integers(1, 4), st.lists(st.integers(0, 40), max_size=3), st.integers(1, 9))
def test_streams_of_ranges(rows, least, cuts, size):
    """However rows are cut into ranges and batches, what goes is what the definition says."""
    rows = sorted({(h, 0, -doc, 0, pos) for h, doc, pos in rows})
    holders = defaultdict(set)
    for h, _, doc, _, _ in rows:
        holders[h].add(doc)
    want = {r for r in rows if len(holders[r[0]]) >= least and r[2] != min(holders[r[0]])}
    edges, gone, open_, witness = sorted({0, *(min(c, len(rows)) for c in cuts), len(rows)}), set(), set(), defaultdict(set)
    for lo, hi in zip(edges, edges[1:]):
        part = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[at : min(at + size, hi)])], line_dedup.NAMES[1:]) for at in range(lo, hi, size)]
        for b in line_dedup.streamed(part, least):
            for kind, h1, h2, doc, t, pos in zip(*(c.to_pylist() for c in b.columns)):
                if kind == line_dedup.WITNESS:
                    witness[h1].add(doc)
                else:
                    (gone if kind == line_dedup.GONE else open_).add((h1, h2, doc, t, pos))
    assert gone | {r for r in open_ if len(witness[r[0]]) >= least and r[2] != min(witness[r[0]])} == want


def test_lines_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(registry.ORACLES["op11_line_dedup"]).fetchall())
    assert sorted(tuple(r) for r in line_dedup.op11_line_dedup(spark, DATA).collect()) == want
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert want == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(list(zip(texts["doc_id"], texts["text"]))))


# whitening


def plain_whitening(x, components):
    u = np.unique(x, axis=0)
    c = u - u.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(u))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return len(u), u.sum(axis=0), (x - u.mean(axis=0)) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / len(u))


def by_component(rows):
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    k = max(r["component"] for r in rows)
    return np.array([r["whitened"] for r in rows]).reshape(-1, k), rows


@pytest.mark.parametrize("dims, n", [(5, 30), (40, 200), (70, 600)])
def test_whitening_by_dense_algebra(spark, dims, n):
    rng = np.random.default_rng(dims)
    data = (rng.standard_normal((n, dims)) * np.linspace(0.3, 2, dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(n + i, data[0].tolist()) for i in range(20)]
    found, rows_ = by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect())
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    count, sums, want, explained = plain_whitening(x, 16)
    sign = np.sign((found * want).sum(axis=0))
    assert np.abs(found - sign * want).max() < 1e-9 and found.shape == want.shape
    assert {r["n"] for r in rows_} == {count} and max(r["identity_error"] for r in rows_) < 1e-10
    assert np.allclose([r["explained"] for r in rows_[: len(explained)]], explained, rtol=1e-12)
    exact = [sum((count * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert [r["deviation"] for r in rows_[:: found.shape[1]]] == exact


def test_whitening_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [2.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert Counter(r["vec_id"] for r in got) == {6: 2, 7: 4, None: 2, 9: 2}  # a single vector of three entries has no variance
    assert {r["n"] for r in got} == {4}
    # of equal vectors only, and of none, nothing can be whitened
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id bigint, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>, n int")).count() == 0


def test_whitening_of_large_entries(spark):
    """Deviations beyond a long are null, those within are exact."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} or {r["vec_id"] for r in got if r["deviation"] is None} == {1, 2}
    assert whitening.deviations(np.array([[2**40, 1], [5, 7]]), 3, [2**20, 9]) == [None, (15 - 2**20) ** 2 + (21 - 9) ** 2]
    assert whitening.deviations(np.array([[2**40, 1], [2**40 + 2, 7]]), 2, [2**41 + 2, 8]) == [4 + 36, 4 + 36]


def test_filter_damps_and_counts_passes(spark):
    """A spectrum with a gap is certified in a few steps; bounds hold."""
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 60)) * np.r_[np.linspace(3, 6, 16), np.linspace(0.5, 1, 44)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    found, jobs = whitening.fit(vectors)
    x = np.floor(64 * data) + 1_000_000
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(found[60].values, values[:16], rtol=1e-12) and jobs < 50
    passes = whitening.Passes(whitening.usable(vectors).select("x"))
    centre = passes.centres()
    assert 0 <= whitening.lower_bounds(passes, centre, [60])[60] <= values[-1]
    q = whitening.start(60, 3)
    assert np.allclose(passes.products(centre, {60: q})[60], np.cov(x.T, bias=True) @ q)


# spelling


def edits(word, alphabet):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in alphabet)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in alphabet)


def plain_variants(rows, typos=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % typos == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    alphabet = {c for w in words for c in w}
    near = {w: sorted({e for e in edits(w, alphabet) if e in words} - {w}, key=lambda o: (-words[o], o)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 2 * words[w] else None for w, o in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def got_variants(docs, **more):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in spelling.variants(docs, **more).collect())


def variant_texts(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÀ") for _ in range(r.randrange(4, 9))) for _ in range(40)]
    for w in list(base):
        base += r.sample([e for e in edits(w, "abé") if e], 4)
        base.append("".join(r.sample(w, len(w))))
    return [" ".join(r.choice(base) + r.choice(["", ".", "'s", "1"]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("crowd, typos, parts", [(1000, 97, 5), (1, 3, 5), (4, 97, 4), (0, 97, 2)])
def test_variants_by_plain_loop(spark, crowd, typos, parts):
    """Also with crowded signatures dealt out by halves, and with many typos."""
    texts = variant_texts(crowd, 200)
    assert got_variants(documents(spark, texts), crowd=crowd, typos=typos, parts=parts) == plain_variants(list(enumerate(texts)), typos)


def test_variants_of_hard_rows(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "Wordlike wordlike WORDLIKE wordlik wordlik wordlik wordlik wordlik wordlik ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ×÷×÷× ×÷×÷× ×÷×÷×")] * 2
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, word int")
    got = got_variants(docs)
    assert got == plain_variants(rows)
    assert ("wordlike", "wordlik", "wordlik", 6, 1, 12) in got and ("×÷×÷×", "", "×÷×÷×", 6, 0, 0) in got
    assert got_variants(docs.limit(0)) == []


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w5")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{k}", "w37") for k in range(37)} | {("x", "w37")}


@settings(max_examples=500, deadline=None)
@given(st.text("abcé", max_size=7), st.text("abcé", max_size=7))
def test_near_and_signatures(a, b):
    cells = spelling.Cells()
    want = a != b and b in set(edits(a, "abcé"))
    assert spelling.is_near(a, b) == want
    if want:
        short = min(len(a), len(b))
        one, two = cells.signatures([a, b])
        kind = cells.kind_of(*sorted((a, b), key=len))
        assert one[kind] == two[kind]
        first = [k for k in range(len(one)) if one[k] == two[k] and (k < len(cells.pairs)) == (len(a) == len(b))]
        assert kind == first[0] and any(x == y for x, y in zip(spelling.halves(a, short), spelling.halves(b, short)))


def test_variants_query(spark):
    texts = table(spark, DATA, "documents").select("doc_id", "text").collect()
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in spelling.op13_spelling(spark, DATA).collect())
    assert got == plain_variants([tuple(r) for r in texts])


def test_whitening_query(spark):
    rows = table(spark, DATA, "embeddings").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], np.float64)).astype(np.int64) + 1_000_000
    found, rows_ = by_component(whitening.op12_whitening(spark, DATA).collect())
    count, _, want, _ = plain_whitening(x, 16)
    assert np.abs(found - np.sign((found * want).sum(axis=0)) * want).max() < 1e-9 and {r["n"] for r in rows_} == {count}
