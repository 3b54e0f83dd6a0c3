"""Operators against brute force on small fixtures."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, embeddings, encoding, language_id, lm_score, packing, quality, simhash, sketches, token_files, url_filter
from tallyloom.llm.common import PIECE, components, shared_dir, spanning
from tests.llm.helpers import documents, words

DATA = "/root/testdata/sf0.001"
PATTERN = regex.compile(public_tokenizers.PATTERN)
RANKS = byte_bpe.read_ranks()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def table():
    return pq.read_table(f"{DATA}/documents.parquet").to_pydict()


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=list("ab Zé\n\t\x1c\x85  　.,'s19_<|ñ²Ⅷα日"), max_size=16))
def test_pieces_cut_only_where_the_pattern_does(text):
    pieces = PIECE.findall(text)
    assert "".join(pieces) == text
    assert sum((PATTERN.findall(p) for p in pieces), []) == PATTERN.findall(text)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {row["node"]: row["component"] for row in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups(200, edges)
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]}


def test_spanning_keeps_components():
    rng = np.random.default_rng(1)
    for same in (True, False):
        near = rng.random((30, 30 if same else 20)) < 0.04
        if same:
            near = (near | near.T) & ~np.eye(30, dtype=bool)
        i, j = spanning(near, same)
        shift = 0 if same else 30
        every = [(a, b + shift) for a, b in zip(*np.nonzero(near))]
        assert near[i, j].all() and len(i) < near.shape[0] + near.shape[1]
        assert groups(60, every) == groups(60, list(zip(i, j + shift)))


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in regex.split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [2048, 8])
def test_simhash(spark, monkeypatch, block):
    base = words(60, 3).split()
    r = random.Random(5)
    texts = [" ".join(base)] * 3 + ["", None, "One TWO", "a b C d É"]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "z"
        texts.append(" ".join(w))
    texts += [words(40, 100 + i) for i in range(20)]
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, 2, block))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_components(documents(spark, texts)).collect()}
    fps = [brute_fingerprint(t or "") for t in texts]
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(fps))}


@pytest.mark.parametrize("block,bins,size", [(2048, 4, 1 << 25), (16, 2, 1 << 10), (8, 4, 1 << 25)])
def test_embeddings(spark, block, bins, size):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    x = np.vstack([base[i % 12] + rng.normal(size=24) * rng.choice([0, 0.1, 0.3]) for i in range(160)]).astype(np.float32)
    label = [int(i) for i in rng.integers(0, 2, 160)]
    v = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(160)], "vec_id bigint, embedding array<float>, label int")
    d = x.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    near = (cos >= 0.93) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(160, dtype=bool)
    want = groups(160, list(zip(*np.nonzero(near))))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(v, block=block, bins=bins, size=size).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(160)}
    assert near.sum() > 100


def test_sketches(spark, table):
    texts = table["text"][:60] + ["", "one", words(300, 1)]
    got = {r["doc_id"]: r for r in sketches.compare_with_next(documents(spark, texts)).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    off = []
    for i, t in enumerate(texts):
        follow = texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        other = t[: len(t) - cut] + follow[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        off += [abs(r["near_edited"] - like(shingles(t), shingles(other))), abs(r["near_next"] - like(shingles(t), shingles(follow)))]
    assert max(off) < 0.2 and np.mean(off) < 0.02


@given(st.lists(st.integers(0, 60), max_size=60), st.lists(st.integers(0, 60), max_size=60))
def test_sketches_merge(a, b):
    h = lambda xs: sketches._mixed(np.array(xs, np.uint64)) if xs else sketches.EMPTY
    k = 16
    assert (sketches.merge([sketches.merge([h(a)], k), sketches.merge([h(b)], k)], k) == sketches.merge([h(a + b)], k)).all()
    s = sketches.merge([h(a)], k)
    assert (sketches.sketch_of(sketches.text_of(s)) == s).all()
    if len(set(a)) < k:
        assert sketches.distinct_shingles(s, k) == len(set(a))


def test_packing(spark, table):
    code = encoding.PieceEncoder(encoding.read_vocabulary()).tokenizer
    texts = table["text"] + [None, "", words(9000, 2)]
    ids = {i: code.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts).repartition(5), encoding.read_vocabulary(), windows=4).collect()
    seen = {i: [] for i in ids}
    sequences: dict = {}
    for r in rows:
        full = ids[r["doc_id"]]
        part = np.array(full[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(full) and r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"] > 0
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in seen.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]]))[:-1] and sum(n for _, n in parts) == len(ids[i])
    for parts in sequences.values():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]]))[:-1] and sum(n for _, n in parts) <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(sequences)) > 0.93


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 5))
def test_windows_hold_everything_once(sizes, most):
    w, out = packing.Windows(50, most), []
    for k, size in enumerate(sizes):
        out += w.place(size, (k,))
        assert len(w.room) <= most
    out += w.rest()
    assert sorted(k for _, rows in out for k, _ in rows) == list(range(len(sizes)))
    for _, rows in out:
        at = 0
        for k, offset in rows:
            assert offset == at
            at += sizes[k]
        assert at <= 50


def test_token_files(spark, table):
    code = encoding.PieceEncoder(encoding.read_vocabulary()).tokenizer
    texts = table["text"] + [None, words(9000, 2)]
    folder = f"{shared_dir(spark)}/tokens-test"
    manifest = token_files.write_tokens(documents(spark, texts), folder, encoding.read_vocabulary())
    start = 0
    for r in sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r["doc_id"]):
        ids = code.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for m in manifest.collect():
        f = token_files.TokenFile(m["file"])
        real = 0
        for k in range(f.reader.num_record_batches):
            ids, mask = f.batch(k)
            real += mask.true_count
            assert (ids[0] == f.sequence(k * token_files.BATCH)).all() and ids.shape[1] == 2048
            for row in range(len(ids)):
                bits = np.unpackbits(f.mask(k * token_files.BATCH + row), bitorder="little")
                assert bits.tolist() == mask[row * 2048 : row * 2048 + 2048].to_numpy(zero_copy_only=False).tolist()
            before = pa.total_allocated_bytes()
            views = f.sequence(k * token_files.BATCH), f.mask(k * token_files.BATCH), *f.batch(k)
            assert pa.total_allocated_bytes() == before and not views[0].flags.owndata and not views[1].flags.owndata  # views of the mapped file
        assert real == m["n_tokens"]


@pytest.fixture(scope="module")
def ranks():
    return RANKS


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@pytest.mark.parametrize("frequent", [1_500_000, 50, 0])
def test_byte_bpe(spark, table, ranks, library, frequent):
    r = random.Random(4)
    texts = table["text"][:40] + ["", None] + ["".join(r.choice("abtheé\n\t  .,'s12_<|ñ²日本") for _ in range(r.randrange(30))) for _ in range(200)]
    texts += ["x" * n for n in (61, 62, 63, 64)] + ["".join(r.choice("aeinrst") for _ in range(n)) for n in (60, 61, 62, 63, 64, 500, 500)] + [" " * 90, "1" * 70 + "!" * 63 + "é" * 31 + " " + "é" * 32]
    got = byte_bpe.encode(documents(spark, texts), ranks, public_tokenizers.PATTERN, frequent=frequent)
    got = got.withColumns({"text": byte_bpe.decoded("ids", ranks), "raw": byte_bpe.little_endian("ids", ranks)})
    for row in got.collect():
        text = texts[row["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert row["ids"] == ids and bytes(row["text"]) == text.encode() and bytes(row["raw"]) == np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst0é", min_size=1, max_size=40))
def test_words_merge_as_the_library_does(word):
    ids = LIBRARY.encode_ordinary(word)
    assert [RANKS[t] for w in PATTERN.findall(word) for t in byte_bpe.merge_word(w.encode(), RANKS)] == ids


def test_a_word_of_100_000_letters(spark, ranks, library):
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "a" * 100_000]
    start = time.monotonic()
    got = {row["doc_id"]: row["ids"] for row in byte_bpe.encode(documents(spark, texts), ranks, public_tokenizers.PATTERN).collect()}
    assert time.monotonic() - start < 60
    assert got[0] == library.encode_ordinary(texts[0])
    assert "".join(library.decode([k]) for k in got[1]) == texts[1] and got[1][:1000] == library.encode_ordinary("a" * 8000)[:1000]


def test_letters_that_java_does_not_know(spark, ranks, library):
    """Code points whose class differs between the regex library and Java 17 (Unicode 13): the ids are the same."""
    letter = regex.compile(r"\p{L}|\p{N}")
    newer = [c for c in map(chr, [*range(0x0870, 0x0890), *range(0x10570, 0x105C0), *range(0x12F90, 0x12FF1), *range(0x16A70, 0x16ACA), *range(0x31350, 0x313B0, 3), *range(0x1DF00, 0x1DF1F)]) if letter.match(c)]
    texts = [f"a{c}b {c}{c}1 日{c}.{c} x" for c in newer]
    assert len(texts) > 200
    for row in byte_bpe.encode(documents(spark, texts), ranks, public_tokenizers.PATTERN, frequent=0).collect():
        assert row["ids"] == library.encode_ordinary(texts[row["doc_id"]])


def test_only_runs_that_may_be_tokens_are_looked_up(ranks):
    """No token within a match is missed; of the other runs, most of all, hardly any is left."""
    r = random.Random(12)
    pieces = [" " + "".join(r.choice(["tion", "the", "é", "s", "er", "qu", "ó", "x"]) for _ in range(r.randrange(1, 9))) for _ in range(6000)]
    pieces += ["don't'll12 ab", "\n\nab", " 日本語x", "'s" * 20, "a" * 62, "x"]
    found = byte_bpe.Runs(ranks, public_tokenizers.PATTERN).finder()(pieces).to_pylist()
    tokens, others, every = 0, 0, 0
    for piece, got in zip(pieces, found, strict=True):
        words = [w.encode() for w in PATTERN.findall(piece)]
        assert got["word"] == piece.encode() == b"".join(words)
        runs, start = set(), 0
        for w in words:
            runs |= {(start + i) * 64 + k for i in range(len(w)) for k in range(2, len(w) - i + 1)}
            start += len(w)
        known = {run for run in runs if got["word"][run >> 6 :][: run & 63] in ranks}
        assert got["runs"] == sorted(got["runs"]) and known <= set(got["runs"]) <= runs
        tokens, others, every = tokens + len(known), others + len(got["runs"]) - len(known), every + len(runs)
    assert others < 0.02 * (every - tokens) and every > 3 * tokens


def test_no_pieces_have_no_runs(ranks):
    assert byte_bpe.Runs(ranks, public_tokenizers.PATTERN).finder()([]).to_pylist() == []


def test_every_token_folds_to_its_rank(spark, ranks, tmp_path):
    tokens = [t for t in ranks if len(t) <= byte_bpe.BITS]
    words = [[{"word": t, "runs": [i * 64 + k for i in range(len(t)) for k in range(2, len(t) - i + 1)]}] for t in tokens]
    pq.write_table(pa.table({"words": pa.array(words, pa.list_(pa.struct({"word": pa.binary(), "runs": pa.list_(pa.int16())})))}), tmp_path / "words.parquet")
    got = spark.read.parquet(str(tmp_path / "words.parquet")).select("words.word", byte_bpe.bpe(F.col("words"), byte_bpe.RankMap(ranks)).alias("ids")).collect()
    assert len(got) == len(tokens) and all(row["ids"] == [[ranks[bytes(row["word"][0])]]] for row in got)


def test_a_vocabulary_must_be_made_of_merges():
    with pytest.raises(ValueError):
        byte_bpe.RankMap({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def backoff_scores(texts, order):
    """(words, backed off, score) of each text by a model of all others."""
    tokens = [(t or "").encode().lower().split() for t in texts]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in tokens] for k in range(1, order + 1)]
    every = [sum(g, Counter()) for g in grams]
    n = sum(every[0].values())
    out = []
    for d, w in enumerate(tokens):
        count = lambda g: every[len(g) - 1][g] - grams[len(g) - 1][d][g]  # noqa: B023, E731
        total, off = 0.0, 0
        for i in range(len(w)):
            first = max(0, i - order + 1)
            for at in range(first, i + 1):
                g = tuple(w[at : i + 1])
                if at == i:
                    total += np.log(max(1, count(g)) / n)
                elif count(g):
                    total += np.log(count(g) / count(g[:-1]))
                    break
                else:
                    off += at == first
                    total += np.log(0.4)
        out.append((len(w), off, total))
    return out


@pytest.mark.parametrize("order,chunk", [(3, 4_000_000), (2, 1), (4, 30), (1, 7)])
def test_stupid_backoff(spark, order, chunk):
    r = random.Random(6)
    texts = ["a b a b c", "A b\tc d", "", None, "x", "a b a b c", "é É \x1f z"] + [" ".join(r.choice("abcdef") for _ in range(r.randrange(12))) for _ in range(60)] + ["a " * 700]
    want = backoff_scores(texts, order)
    for row in lm_score.stupid_backoff(documents(spark, texts).repartition(3), order, chunk_words=chunk).collect():
        n, off, total = want[row["doc_id"]]
        assert (row["n_words"], row["backed_off"]) == (n, off)
        assert row["log_score"] == (pytest.approx(total, abs=1e-3) if n else None)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.lists(st.integers(1, 2**40), max_size=40))
def test_blocks_keep_keys_and_counts(keys, counts):
    k, n = np.sort(np.array(keys, np.uint64)), np.array(counts, np.int64)
    assert (lm_score.unpack_keys(*lm_score.pack_keys(k)) == k).all()
    assert (lm_score.unpack_counts(lm_score.pack_counts(n), len(n)) == n).all()


def test_trust_and_distrust_follow_links(spark):
    html = lambda *to: "".join(f'<p><a class="x" href="{u}">x</a>' for u in to)
    pages = spark.createDataFrame([
        (0, "http://good.org/a", html("http://friend.net/1", "//friend.net/2", "/own")),
        (1, "http://friend.net/a", html("https://third.net/")),
        (2, "http://bad.com/de/1", html("http://good.org/a")),
        (3, "http://linker.net/a", html("http://bad.com/de/1", "HTTP://BAD.com/x")),
        (4, "http://third.net/a", None), (5, "http://bad.com/other", ""), (6, "http://alone.net/", ""),
    ], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["by"]) for r in url_filter.url_verdicts(pages).collect()}
    assert got == {0: ("allow", "rule"), 1: ("allow", "graph"), 2: ("block", "rule"), 3: ("block", "graph"), 4: ("allow", "graph"), 5: ("block", "graph"), 6: ("allow", "graph")}
    edges = {(r["src"], r["dst"]): r["links"] for r in url_filter.host_edges(pages).collect()}
    assert edges == {("good.org", "friend.net"): 2, ("friend.net", "third.net"): 1, ("bad.com", "good.org"): 1, ("linker.net", "bad.com"): 2}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    counts, trans = np.array([3, 0, 1, 4]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    got, pairs = quality.forward_backward(unary, trans, counts)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        total, marginal, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(unary[at + k] * y[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            marginal += p * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += p
        want += list(marginal / total)
        want_pairs += both / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_quality_and_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.op1_quality(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language_id.op7_language_id(spark, d).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97
