"""The pipeline's language stage lets the score decide."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import language_id


def letters(alphabet, r, n=120):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_unlearned_scripts_and_noise_go(spark):
    r = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 200")
    rows = [(10**6 + i, letters(a, r), None) for i, a in enumerate(["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя", "abcdefghijklmnopqrstuvwxyz"] * 20)]
    out = corpus_pipeline.keep_known_language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), "")
    kept, other = out.agg(F.count_if(F.col("doc_id") < 10**6), F.count_if(F.col("doc_id") >= 10**6)).first()
    assert kept >= 0.98 * docs.count()
    assert other <= 3


def test_nothing_learned_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123", None), (3, "ещё слова", None)], "doc_id bigint, text string, lang string")
    assert corpus_pipeline.keep_known_language(spark, docs, "").count() == 3


def test_every_language_is_learned(spark):
    """45 languages, one of them with few documents, under a bound of rows that leaves each a handful."""
    r = random.Random(2)
    own = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3)] for k in range(45)}
    rows = [(i, " ".join(r.choices(own[lang], k=12)), lang) for i, lang in enumerate(sorted(own) * 12)] + [(10_000 + i, "x" * 30, "l00") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs, rows=450)
    assert model.langs == sorted(own)
    found = language_id.predict(docs.where("doc_id < 10000"), model).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    assert {r["lang_pred"] for r in found} == set(own)
    assert len(language_id.train(docs, rows=1).langs) == 45


def test_floors_come_from_all_held_out_texts(spark, monkeypatch):
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), F.lit("a text of some thirty letters ab").alias("text"), F.lit("en").alias("lang"))
    held = docs.where(language_id.is_held_out(F.col("doc_id"))).count()
    assert held > 2000
    monkeypatch.setattr(language_id, "SEEN", held)
    assert set(language_id.floors(docs, language_id.train(docs))) == {20}
