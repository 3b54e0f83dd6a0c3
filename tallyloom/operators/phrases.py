"""Many phrases at once, and the gate for whole transcripts.

All phrases are put into one automaton (Aho-Corasick), which finds every occurrence of
any of them in one pass over a text, however many there are. Texts are not moved and not
compared phrase by phrase.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.gates import FOOTER, MARK, MARKS, PRIVATE, TRANSCRIPT, codes, sql_codes
from tallyloom.operators.rules import LEAK, PATH, SECRET
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

BLOCK = 200_000  # phrases of an automaton; more make further automata, each of which sees every text


def automaton(phrases: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Finds the ids of phrases (id, phrase); those of a phrase that is given twice are all found."""
    found = ahocorasick.Automaton()
    for number, phrase in phrases:
        found.add_word(phrase, (*found.get(phrase, ()), number))
    found.make_automaton()
    return found


_held: dict[str, ahocorasick.Automaton] = {}


def phrase_counts(texts: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, phrase_id, n: how often each phrase occurs in each text, overlaps counted.

    texts: id, text; phrases: phrase_id, phrase. Null texts and null or empty phrases
    occur nowhere. The phrases are counted first; the driver and each worker hold the
    automaton of a block of them.
    """
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    wanted = phrases.where("length(phrase) > 0").select(F.col("phrase_id").cast("bigint"), "phrase")
    blocks = max(1, -(-wanted.count() // block))
    texts = texts.where("text is not null").select("id", "text")
    out = None
    for k in range(blocks):
        part = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()]
        if not part:
            continue
        shared, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            if key not in _held:
                _held.clear()
                _held[key] = automaton(shared.value)
            finder = _held[key]
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    ids, row, number, n = b.column(0).slice(at, 500), [], [], []
                    for i, text in enumerate(b.column(1).slice(at, 500).to_pylist()):
                        seen: dict[int, int] = {}
                        for _, numbers in finder.iter(text):
                            for x in numbers:
                                seen[x] = seen.get(x, 0) + 1
                        row += [i] * len(seen)
                        number += seen
                        n += seen.values()
                    yield pa.record_batch([ids.take(pa.array(row, pa.int64())), pa.array(number, pa.int64()), pa.array(n, pa.int64())], ["id", "phrase_id", "n"])

        one = texts.mapInArrow(run, f"id {kind}, phrase_id bigint, n bigint")
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], f"id {kind}, phrase_id bigint, n bigint") if out is None else out


def sentences(t: Tables) -> DataFrame:
    """phrase_id, phrase: every sentence of ten characters or more of the benchmark items, numbered by item and place."""
    b = t.read("benchmark").where("text is not null").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("place", "phrase"))
    return b.where("length(phrase) >= 10").select((F.col("item_id") * 1000 + F.col("place")).alias("phrase_id"), "phrase")


@query("known_phrases", r"""
WITH b AS (SELECT item_id, string_split(text, '. ') AS s FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id * 1000 + place - 1 AS phrase_id, phrase FROM (SELECT item_id, unnest(s) AS phrase, generate_subscripts(s, 1) AS place FROM b) WHERE length(phrase) >= 10)
SELECT doc_id, count(*) AS phrases, min(phrase_id) AS first_phrase, max(phrase_id) AS last_phrase FROM documents JOIN p ON contains(text, phrase) GROUP BY doc_id""")
def known_phrases(t: Tables) -> DataFrame:
    """Documents that hold sentences of benchmark items: how many, the first and the last one."""
    found = phrase_counts(t.read("documents").select(F.col("doc_id").alias("id"), "text"), sentences(t))
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("phrases"), F.min("phrase_id").alias("first_phrase"), F.max("phrase_id").alias("last_phrase"))


#: Readings of worn print that stand for other words; a list of our own, to which a user adds.
CORRUPT = ("tbe ", " ofthe ", " aud the ", "vv", " arid the ", " h0w", " 1s ", " wlth ", " frorn ", " tirne", "ﬁﬁ")
SPLIT_WORD = r"(?i)\b(?:t he|th e|a nd|an d|w ith|wit h|fro m|o f the|tha t)\b"
CLOSING = "“[^”\"\n]{1,400}[.,!?]['’](?:\\s|$)"  # what was opened by a double mark is closed by a single one
VISUAL = r"(?m)^\[[^\]\n]{10,}\]$"


def line_marks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), lambda x: x.cast("int"))


@query("transcript_review", rf"""
WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, '[A-Za-z0-9]+') AS w, list_transform(regexp_extract_all(text, '{MARK}', 1), lambda x: x::INT) AS marks FROM d)
SELECT doc_id, {sql_codes(length='length(text) NOT BETWEEN 400 AND 20000', words='len(w) < 80', private_glyph=f"regexp_matches(text, '{PRIVATE}')", footer=f"regexp_matches(text, '{FOOTER}')", leak=f"regexp_matches(text, '{LEAK}')",
    corrupt=' OR '.join(f"contains(text, '{c}')" for c in CORRUPT), split_word=f"regexp_matches(text, '{SPLIT_WORD}')", closing=f"regexp_matches(text, '{CLOSING.replace(chr(39), chr(39) * 2)}')",
    path=f"regexp_matches(text, '{PATH}')", secret=f"regexp_matches(text, '{SECRET}')", few_marks='len(marks) < 3', marks_differ='marks <> range(1, len(marks) + 1)', visuals=f"len(regexp_extract_all(text, '{VISUAL}')) <> 0")} AS violations FROM m""")
def transcript_review(t: Tables) -> DataFrame:
    """All rules that a transcript breaks, known corruptions among them, with the printed numbers that it must have: 1, 2, 3 and so on, and no described pictures."""
    docs = t.read("documents").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    listed = t.spark.createDataFrame(list(enumerate(CORRUPT)), "phrase_id bigint, phrase string")
    corrupt = phrase_counts(docs.withColumnRenamed("doc_id", "id"), listed).select(F.col("id").alias("doc_id")).distinct().withColumn("corrupt", F.lit(True))
    return review(docs.join(corrupt, "doc_id", "left"))


def review(docs: DataFrame, expected: Column | None = None, visuals: int = 0) -> DataFrame:
    """doc_id, violations of docs (doc_id, text, corrupt); expected: the printed numbers (else 1, 2, 3 and so on); visuals: how many pictures are described."""
    text = F.col("text")
    m = docs.select("doc_id", "text", "corrupt", F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("words"), line_marks(text).alias("marks"))
    counted = F.when(F.size("marks") > 0, F.sequence(F.lit(1), F.size("marks"))).otherwise(F.array().cast("array<int>"))
    return m.select("doc_id", codes(
        length=~F.length(text).between(*TRANSCRIPT[:2]), words=F.col("words") < TRANSCRIPT[2], private_glyph=text.rlike(PRIVATE), footer=text.rlike(FOOTER), leak=text.rlike(LEAK), corrupt=F.coalesce("corrupt", F.lit(False)),
        split_word=text.rlike(SPLIT_WORD), closing=text.rlike(CLOSING), path=text.rlike(PATH), secret=text.rlike(SECRET), few_marks=F.size("marks") < MARKS, marks_differ=F.col("marks") != (counted if expected is None else expected),
        visuals=F.size(F.regexp_extract_all(text, F.lit(VISUAL), F.lit(0))) != visuals).alias("violations"))
