"""Empty tables, nulls, repeated rows, very long texts and extra columns, for every operator."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import byte_bpe, embeddings, encoding, language_id, lm_score, near_copies, packing, quality, simhash, sketches, token_files, url_filter
from tallyloom.llm.common import file_system, parts_for, shared_dir, sliced
from tests.llm.helpers import HARD, documents, words

VOCAB = encoding.read_vocabulary()
RANKS = byte_bpe.read_ranks()


def run_quality(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "1 as toxic")
    return quality.score(docs, quality.train(docs, labels))


def run_language(spark, docs):
    return language_id.predict(docs, language_id.train(docs.selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'en' when doc_id % 3 = 0 then 'de' end as lang")))


def run_tokens(spark, docs):
    import uuid

    return token_files.read_tokens(token_files.write_tokens(docs, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", VOCAB))


def run_bpe(spark, docs):
    import public_tokenizers

    return byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


RUNS = {
    "quality": run_quality,
    "language": run_language,
    "lm": lambda spark, d: lm_score.stupid_backoff(d),
    "sketch": lambda spark, d: sketches.compare_with_next(d),
    "packing": lambda spark, d: packing.pack(d, VOCAB),
    "simhash": lambda spark, d: simhash.near_components(d),
    "bpe": run_bpe,
    "tokens": run_tokens,
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_hard_rows(spark, name):
    docs = documents(spark, HARD).union(documents(spark, HARD[:7])).union(spark.createDataFrame([(None, "null id text", None)], "doc_id bigint, text string, component_id string"))
    rows = RUNS[name](spark, docs).collect()
    ids = [r["doc_id"] for r in rows]
    if name == "packing":
        assert set(ids) == {*range(len(HARD)), None}
    else:
        assert sorted(ids, key=str) == sorted([*range(len(HARD)), *range(7), None], key=str)


def by_id(spark, name):
    return {r["doc_id"]: r for r in RUNS[name](spark, documents(spark, HARD)).collect()}


def test_values_of_hard_rows(spark):
    blank = [i for i, t in enumerate(HARD) if not (t or "").strip()]
    found = by_id(spark, "quality")
    assert all(found[i]["quality_score"] == 0.0 for i in blank) and all(r["component_id"] == "pair" for r in found.values())
    found = by_id(spark, "language")
    assert all((found[i]["lang_pred"], found[i]["lang_score"]) == ("und", 0.0) for i in blank)
    found = by_id(spark, "lm")
    assert all((found[i]["n_words"], found[i]["log_score"]) == (0, None) for i in blank)
    found = by_id(spark, "simhash")
    assert all(found[i]["fingerprint"] == "0" * 16 and found[i]["component_id"] == 0 for i in blank)
    found = by_id(spark, "tokens")
    assert [found[i]["n_tokens"] for i in (0, 1)] == [1, 1]
    found = by_id(spark, "bpe")
    assert [found[i]["ids"] for i in (0, 1)] == [[], []]


def test_null_id_is_first_in_order(spark):
    rows = [(None, "null id"), (3, "b b"), (3, "a a"), (1, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    places = sorted((r["start"], r["doc_id"]) for r in run_tokens(spark, docs).collect())
    assert [d for _, d in places] == [None, 1, 3, 3]
    sketched = sketches.compare_with_next(docs).collect()
    assert next(r["edited_sha256"] for r in sketched if r["doc_id"] is None) == hashlib.sha256(b"null io").hexdigest()  # a quarter of seven is one letter


def test_long_texts_in_parts(spark):
    """The branches for texts of over 65,536 and 100,000 words give what one part would."""
    text = words(150_000, 3, 10**7)
    assert (sketches.sketch(text) == sketches.merge([sketches.shingle_hashes(text.split())])).all()
    tokens = text.encode().split()
    ones = np.zeros(64, np.int64)
    for i in range(len(tokens) - 2):
        ones += np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + 3]), 42)], "<u8").view(np.uint8), bitorder="little")
    assert simhash.fingerprint(text) & (2**64 - 1) == sum(1 << k for k in range(64) if 2 * ones[k] > len(tokens) - 2)
    s = near_copies.shingles(text)
    bits = np.unpackbits(s.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    assert near_copies.majority(s) & (2**64 - 1) == sum(1 << k for k in range(64) if 2 * bits[k] > len(s))


def test_ties(spark):
    """Equal texts have equal results whatever their place."""
    docs = documents(spark, ["the same words stand here twice and once more"] * 6)
    assert len({(r["lang_pred"], r["lang_score"]) for r in run_language(spark, docs).collect()}) == 1
    rows = packing.pack(docs, VOCAB, length=64).collect()
    assert len({(r["length"], r["ids_crc32"]) for r in rows}) == 1 and sum(r["length"] for r in rows) == 6 * rows[0]["doc_tokens"]


def test_session_settings_stay(spark):
    before = {k: v for k, v in spark.conf.getAll.items()}
    for name in RUNS:
        RUNS[name](spark, documents(spark, HARD[:6])).count()
    assert {k: v for k, v in spark.conf.getAll.items()} == before


def test_no_local_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_file_systems(monkeypatch):
    fs, path = file_system("file:///tmp/x")
    assert path == "/tmp/x" and fs.type_name == "local"
    asked = []

    class Native:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            if not uri.startswith("s3://"):
                raise pa.ArrowInvalid("unknown scheme")
            return "s3", uri[5:]

    monkeypatch.setattr(pafs, "FileSystem", Native)
    monkeypatch.setattr(pafs, "HadoopFileSystem", lambda host: ("hadoop", host))
    assert file_system("s3a://bucket/x") == ("s3", "bucket/x") and asked == ["s3://bucket/x"]
    assert file_system("abfss://c@a.net/x/y") == (("hadoop", "abfss://c@a.net"), "/x/y")


def test_pipeline_keeps_one_row_of_a_group(spark):
    base = words(300, 5)
    near = base + " and a few more"
    rows = [(1, base, "a"), (1, near, "b"), (2, base, "c"), (1, words(200, 8), "other group"), (None, base, "d"), (3, words(50, 9), "e"), (3, words(50, 9), "e")]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id bigint, text string, source string, _rows double, fp int")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["source"], r["_rows"], r["fp"]) for r in out.collect())
    assert [g[0] for g in got] == [1, 1, 3] and got[2] == (3, "e", 0.5, 7) and {"other group"} < {g[1] for g in got[:2]}


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    names = ["quality_score", "Lang_Score", "lang_pred", "bad_lines", "row", "rid", "_kept"]
    docs = spark.createDataFrame([(i, t, "en", *[f"own{i}"] * len(names)) for i, t in enumerate(HARD)], "doc_id bigint, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        rows = docs.collect()
        assert rows and all(r[n] == f"own{r['doc_id']}" for r in rows for n in names), name


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, nan], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1)]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, rid string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(v).collect())
    linked = {0: 3, 1: 3, 9: 3}
    assert got == sorted((i, linked.get(i, 0), 0 if i in linked else i, i not in (1, 9)) for i, _, _ in rows)
    assert embeddings.near_vectors(v.where("false")).count() == 0


def test_urls(spark):
    rows = [(0, None, None), (1, "no host", "<a href='//x.com/'>"), (2, "http://A.Org/x?q#f", ""), (3, "https://example.org", None), (4, "https://m.example.org/es/1", ""), (4, "https://m.example.org/es/1", "")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, html string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages).collect())
    assert got == [(0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "a.org", "/x", "org/", "allow"), (3, "example.org", "", None, "allow"),
                   (4, "m.example.org", "/es/1", "example.org/es/", "block"), (4, "m.example.org", "/es/1", "example.org/es/", "block")]
    assert url_filter.url_verdicts(pages.where("false")).count() == 0


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(HARD * 2)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint"])
def test_ids_of_any_integer_type(spark, kind):
    docs = spark.createDataFrame([(k, f"text {k} of some") for k in range(5)], "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    found = sketches.compare_with_next(docs)
    assert found.schema["doc_id"].dataType.simpleString() == kind and {r["doc_id"] for r in found.collect()} == set(range(5))
    assert [r["n_tokens"] > 1 for r in run_tokens(spark, docs).collect()] == [True] * 5 and {r["doc_id"] for r in packing.pack(docs, VOCAB).collect()} == set(range(5))


def test_many_empty_texts_have_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    assert parts_for(docs, rows=100) == 30 and parts_for(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_workers_let_go_of_pieces_in_other_stages():
    batch = pa.record_batch([pa.array(["one two"])], ["text"])
    code = encoding.encoder(VOCAB)
    list(code.encode(["one two"]))
    list(sliced([batch], keep=encoding.CACHE))  # a task that encodes
    assert encoding.encoder(VOCAB) is code and code.known
    list(sliced([batch]))  # one that doesn't
    assert not encoding._encoders and encoding.encoder(VOCAB) is not code
