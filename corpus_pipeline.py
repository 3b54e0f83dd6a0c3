"""Corpus pipeline over documents: quality, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
run() writes each stage's rows to the shared folder and reads them back.

Defined results: as those of the operators; a null text is rejected by the first stage;
of each group of near copies one row stays, also where ids repeat; extra columns are
carried along as far as the last stage, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import language_id, near_copies, packing, quality
from tallyloom.llm.common import free_names, materialize, table
from tallyloom.llm.encoding import read_vocabulary

QUALITY_FROM = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, _ = free_names(docs, *quality.COLUMNS)
    return quality.score(docs, model).where(F.col(score) >= QUALITY_FROM).select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; what has no letters goes.

    A text that scores lower than nearly all labelled texts of its length is in none of
    them. A single learned language gives no margin, so that only letterless texts go;
    with nothing to learn from all stay.
    """
    model = language_id.train(docs)
    if not model.langs:
        return docs
    floor = F.lit(0.0)
    for least, score in sorted(language_id.floors(docs, model).items()):
        floor = F.when(F.length("text") >= least, score).otherwise(floor)
    lang, score = free_names(docs, *language_id.COLUMNS)
    found = language_id.predict(docs, model)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= floor)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id.

    Near copies have SimHashes within 3 bits or share 80 % of their five-word shingles.
    """
    return near_copies.kept(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, read_vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_known_language),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # models and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
