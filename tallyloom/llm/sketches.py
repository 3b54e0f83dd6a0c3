"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest of a text's distinct 64-bit shingle hashes, in ascending
order. Sketches of parts merge to the sketch of the whole. Two sketches estimate the
resemblance (Jaccard) of their texts' shingle sets, how much of one is contained in the
other, and the number of distinct shingles; for at most k shingles all are exact.

Words are cut at white space and lower-cased; a shingle has five. A text of fewer words
is one shingle; one without words has an empty sketch, which resembles only another
empty one.

compare_with_next() puts documents in ascending order of doc_id and compares each with
the next, the last with the first. Texts move once, dealt into ranges of doc_id; each
range also gets the first document of the one after it.

Defined results: null text counts as empty; a null doc_id comes before all others; rows
with one doc_id follow each other in order of text, in one range; a single row is its own
next one; very long texts are sketched whole, in parts; ids are integers; extra columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.llm.common import parts_for, sliced, table

K, SHINGLE, SEED = 128, 5, 7
PART = 100_000  # words of a long text sketched at a time
EMPTY = np.empty(0, np.uint64)


class _Hashes(dict):
    """Word hashes; forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return found


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each window of words (repeats included)."""
    if not words:
        return EMPTY
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.full(n, len(w) if len(w) < shingle else shingle, np.uint64)
    for i in range(min(shingle, len(w))):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return h


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return np.unique(np.concatenate([EMPTY, *sketches]))[:k]


def sketch(text: str | None, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    words = (text or "").lower().split()
    parts = []
    for at in range(0, max(1, len(words) - shingle + 1), PART):
        parts.append(merge([shingle_hashes(words[at : at + PART + shingle - 1], shingle)], k))
    return merge(parts, k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the two shingle sets; of two empty ones, 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.unique(np.concatenate([a, b]))[:k]
    return float(np.isin(both, np.intersect1d(a, b, True), True).sum() / len(both))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; of an empty set, 1."""
    if not len(a):
        return 1.0
    like, union = resemblance(a, b, k), distinct_shingles(merge([a, b], k), k)
    return float(min(1.0, like * union / distinct_shingles(a, k)))


def text_of(a: np.ndarray) -> str:
    """A sketch as a string: 16 hex digits for each hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def sketch_of(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """text with its last quarter (code points, rounded down) replaced by as much of the beginning of following."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def dealt_in_order(docs: DataFrame, parts: int) -> DataFrame:
    """range, borrowed, doc_id, at, text: sorted within partitions; borrowed rows are the next range's first."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("at"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def lows(batches):
        low: dict[int, int] = {}
        for b in sliced(batches):
            at = b.column(0).to_numpy()
            for r, x in zip(np.searchsorted(bounds, at, "right").tolist(), at.tolist()):
                low[r] = min(x, low.get(r, x))
        yield pa.record_batch([pa.array(low.keys(), pa.int64()), pa.array(low.values(), pa.int64())], ["range", "low"])

    # one number for each range that has rows
    firsts = rows.select("at").mapInArrow(lows, "range bigint, low bigint").groupBy("range").agg(F.min("low").alias("low")).orderBy("range").collect()
    lend = {first["low"]: firsts[i - 1]["range"] for i, first in enumerate(firsts)}

    def deal(batches):
        lows_ = np.array(sorted(lend), np.int64)
        for b in sliced(batches):
            at = b.column("at").to_numpy()
            own = np.searchsorted(bounds, at, "right").astype(np.int64)
            yield pa.record_batch([pa.array(own), pa.array(np.zeros(len(at), bool)), *b.columns], names)
            if (hit := np.isin(at, lows_)).any():
                to = [lend[x] for x in at[hit].tolist()]
                yield pa.record_batch([pa.array(to, pa.int64()), pa.array([True] * len(to)), *(c.filter(pa.array(hit)) for c in b.columns)], names)

    names = ["range", "borrowed", "doc_id", "at", "text"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(deal, f"range bigint, borrowed boolean, doc_id {kind}, at bigint, text string")
    return out.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "borrowed", "at", "text")


def compare_with_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses; see the contract in op4."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "contained_in_edited"]

    def row(doc_id, text, own, next_text, next_sketch):
        other = edited(text, next_text)
        s = sketch(other, k, shingle)
        return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(s), resemblance(own, s, k), resemblance(own, next_sketch, k), distinct_shingles(own, k), containment(own, s, k))

    def run(batches):
        waiting = None  # the last row read, while its next one isn't known
        for b in sliced(batches):
            done = []
            for where, borrowed, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "borrowed", "doc_id", "text"))):
                if borrowed and (waiting is None or waiting[0] != where):
                    continue  # a further row with the first one's doc_id
                own = sketch(text, k, shingle)
                if waiting is not None and waiting[0] == where:
                    done.append(row(*waiting[1:], text, own))
                waiting = None if borrowed else (where, doc_id, text, own)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double"
    return dealt_in_order(docs, parts_for(docs)).mapInArrow(run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLES: dict[str, str] = {}
