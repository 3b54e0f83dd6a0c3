"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte bigrams, trigrams and word beginnings of the lower-cased text,
as shares of the text's total. A linear one-versus-rest support vector machine for each
family chooses the family; within a family of several languages, a linear machine for
each pair of languages votes, and summed margins break ties. All are trained here, by
dual coordinate descent on a bounded sample of labelled documents of more than ``chars``
characters: of every language at most ``per_language``, and of all languages together at
most ``rows``, shared out evenly (at least one each), those with the smallest hash of
their id, whatever the size of the corpus. No language is left out.

Whole texts are scored: a score is the mean over all n-grams of the n-grams' weights.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are
all texts where there is nothing to learn from; a single learned language is predicted
for every other text; of equal votes and margins, or equal families, the first in the alphabet
is taken; repeated rows are predicted each; rows with a
null id are learned from as any; very long texts take time in proportion to their length;
extra columns are kept, and a new column whose name is taken gets an underscore; an empty
table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_names, sliced, table

#: Family of a language code; a code that isn't here is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk pl cs sk bg sr hr sl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
PER_LANGUAGE, ROWS, CHARS, BITS = 500, 12_000, 20, 12
COLUMNS = ("lang_pred", "lang_score")
UNKNOWN = "und"
#: Least lengths of the classes in which scores are compared; the part of learned texts that a floor may lose, and how many a class needs.
LENGTHS, LOST, SEEN = (20, 50, 100, 200, 400, 800, 1600), 0.005, 100
LETTER = regex.compile(r"\p{L}")


def family(code: str) -> str:
    return FAMILY.get(code.lower().split("-")[0], code)


def ngrams(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed ids of all byte bigrams, trigrams and four-byte beginnings of words."""
    b = np.frombuffer(b" " + text + b"   ", np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    four = three[:-1] << np.uint32(8) | b[3:]
    starts = four[(b[:-3] <= 32) & (b[1:-2] > 32)]
    mix = np.uint32(0x9E3779B1)
    parts = ((two[:-2] ^ np.uint32(0x51ED0000)) * mix, three[:-1] * mix, (starts ^ np.uint32(0x2545F491)) * mix)
    return np.concatenate(parts) >> np.uint32(32 - bits)


def prepared(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def vector(text: str, bits: int = BITS) -> np.ndarray:
    """Square roots of the shares of all n-grams: a unit vector."""
    n = np.bincount(ngrams(prepared(text), bits), minlength=1 << bits)
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (last: bias) of a linear machine; y is 1 or -1. Dual coordinate descent, hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0, c * weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Machines of families and of language pairs, trained on texts' vectors and languages."""

    def __init__(self, vectors: list[np.ndarray], langs: list[str], bits: int = BITS):
        self.bits, self.langs = bits, sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.within = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.within[f], 2)]
        x, lang = np.array(vectors), np.array(langs)
        fam = np.array([family(v) for v in langs])
        machines = [svm(x, np.where(fam == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        for a, b in self.pairs:
            at = (lang == a) | (lang == b)
            machines.append(svm(x[at], np.where(lang[at] == a, 1, -1)))
        self.weights = np.array(machines).reshape(len(machines), (1 << bits) + 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score of 0 to 1, from the margins that decided."""
        if not self.langs or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        m = self.weights[:, :-1] @ vector(text, self.bits) + self.weights[:, -1]
        sure, first = [], len(self.families) if len(self.families) > 1 else 0
        best = self.families[0]
        if first:
            order = np.argsort(-m[:first], kind="stable")
            best = self.families[order[0]]
            sure.append(m[order[0]] - m[order[1]])
        votes = {v: [0, 0.0] for v in self.within[best]}
        for (a, b), margin in zip(self.pairs, m[first:]):
            if a in votes:
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        lang = max(sorted(votes), key=lambda v: votes[v])
        if len(votes) > 1:
            sure.append(votes[lang][1] / (len(votes) - 1) * 2)
        return lang, float(1 / (1 + np.exp(-2 * min(sure)))) if sure else 1.0


def is_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS, rows: int = ROWS, chars: int = CHARS) -> Model:
    """Learn from at most per_language documents of each language (doc_id, text, lang), of all at most rows or one of each.

    Whole texts are turned into vectors where they lie; the driver gets only those
    documents' vectors, of 4 * 2 ** bits bytes (196 MB for 12,000 rows).
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > chars) & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    per_language = max(1, min(per_language, rows // max(1, len(counts))))
    if not counts:
        return Model([], [], bits)
    # a hash threshold that keeps somewhat more than wanted of each language, then exactly that many
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.2 * per_language + 20) / n))))
    near = usable.withColumn("order", F.xxhash64("doc_id", F.lit(11)))
    near = near.where(F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) < F.element_at(share, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("order", "text")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language)

    def run(batches):
        for b in sliced(batches):
            yield pa.record_batch([b.column(0), b.column(1), pa.array([vector(t, bits).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["lang", "order", "vector"])

    found = near.select("lang", "order", "text").mapInArrow(run, "lang string, order bigint, vector binary").collect()
    found.sort(key=lambda r: (r["order"], r["vector"]))
    return Model([np.frombuffer(r["vector"], np.float32) for r in found], [r["lang"] for r in found], bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score (or free_names of these), for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = free_names(docs, *COLUMNS)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        for b in sliced(batches):
            found = [shared.value.predict(t) for t in b.column(text_col).to_pylist()]
            lang, score = zip(*found) if found else ((), ())
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def floors(docs: DataFrame, model: Model) -> dict[int, float]:
    """Least length of a class -> the score that all but LOST of the labelled texts of that length reach.

    All labelled rows that the model hasn't learned from are scored, whole and cut to the
    length of each class, as short texts score lower. A class with fewer than SEEN of them
    has no floor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > CHARS) & is_held_out(F.col("doc_id")))

    def run(batches):
        for b in sliced(batches):
            found = [(n, shared.value.predict(t[:n])) for t in b.column(0).to_pylist() for n in LENGTHS if n <= len(t)]
            found = [(n, score) for n, (lang, score) in found if lang != UNKNOWN]
            yield pa.record_batch([pa.array([n for n, _ in found], pa.int32()), pa.array([v for _, v in found], pa.float64())], ["least", "score"])

    scores = usable.select(F.col("text").cast("string")).mapInArrow(run, "least int, score double")
    rows = scores.groupBy("least").agg(F.percentile_approx("score", LOST, 10000).alias("floor"), F.count("*").alias("n")).collect()
    return {r["least"]: r["floor"] for r in rows if r["n"] >= SEEN}


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
