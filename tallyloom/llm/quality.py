"""Quality classifier: a linear-chain conditional random field over lines.

Every line that isn't blank is labelled good or bad. Its features are those of the line
itself and of its two neighbours; transitions between neighbouring labels are learned
too. A document's quality is the mean of its lines' marginal probabilities of good
(forward-backward), weighted by their length, passed through a fitted logistic curve.

Labels exist for documents only. At first each line takes its document's label; then,
once, the lines of bad documents that the field finds good are relabelled, the worst
line staying bad, and the field is trained again.

It learns from a bounded sample: at most ``per_class`` documents of either label, those
with the smallest hash of their id, and only from documents of at most ``lines`` lines.
Whole texts are turned into features where they lie; all texts are scored whole.

Defined results: null, empty and blank texts have score 0 (bad); repeated rows are
scored each; a document with both labels counts with each; null labels and null ids are
not learned from; equal hashes are ordered by their features; with no label, or only one
value of it, to learn from, every text that isn't blank scores 1 (0 where the only value
is 0); very long texts take time in proportion to their lines; extra columns are kept,
and a new column whose name is taken gets an underscore; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_names, sliced, table

PER_CLASS, LINES = 1500, 1000
COLUMNS = ("quality_score", "bad_lines")
SYMBOLS, STOPS = b"|#$%&*!@^~<>=_+`{}[]/\\", b".,;:'\"?()-"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "stop", "high", "mark")


def _class_table() -> np.ndarray:
    kind = np.full(256, 5)
    for at, chars in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, b" \t\r\x0b\x0c"), (4, SYMBOLS), (6, range(128, 256))):
        kind[list(chars)] = at
    return np.eye(8, dtype=np.int32)[kind] * (np.arange(256) != 10)[:, None] + np.eye(8, dtype=np.int32)[7] * (np.arange(256) == ord("!"))[:, None]


ONE_HOT = _class_table()
OWN = 17  # features of a line itself
SIZE = 3 * OWN


def line_features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that aren't blank, their lengths in bytes, and the number of lines of each text."""
    lines: list[str] = []
    counts, extra = [], []
    for text in texts:
        own = [x for x in text.split("\n") if x.strip()] if text else []
        seen = Counter(own) if len(own) > 1 else {}
        for x in own:
            words = x.split()
            n = len(words)
            extra.append((n, len(set(words)), sum(map(eq, words, words[1:])), seen.get(x, 1) > 1, x.rstrip()[-1] in ".?!:;\"'"))
        lines += own
        counts.append(len(own))
    if not lines:
        return np.zeros((0, OWN), np.float32), np.zeros(0), np.array(counts, np.int64)
    raw = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = np.empty((len(lines), 8))
    step = 4096
    for at in range(0, len(lines), step):  # bounds what the classes of all bytes take
        lo, hi = starts[at], ends[min(at + step, len(lines)) - 1] + 1
        kinds[at : at + step] = np.add.reduceat(ONE_HOT[raw[lo:hi]], starts[at : at + step] - lo, axis=0)
    size = (ends - starts).astype(float)
    n, distinct, again, twice, closed = np.array(extra, float).T
    letters = np.maximum(1, kinds[:, 0] + kinds[:, 1] + kinds[:, 6])
    share = kinds / np.maximum(1, size)[:, None]
    own = np.stack([
        np.ones(len(lines)), np.log1p(size) / 5, kinds[:, 1] / letters, (kinds[:, 1] > 0.5 * letters), share[:, 2], share[:, 3], share[:, 4], np.minimum(1, kinds[:, 4] / n),
        share[:, 5], share[:, 6], kinds[:, 7] / n, np.log1p(n) / 4, np.minimum(3, size / n / 6), 1 - distinct / n, again / n, twice, closed,
    ], axis=1)
    return own.astype(np.float32), size, np.array(counts, np.int64)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and after it in its text (zeros at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[(ends - counts)[counts > 0]] = 0
    after[(ends - 1)[counts > 0]] = 0
    return np.hstack([own, before, after])


def forward_backward(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of good for each line, and the summed marginals of neighbouring labels.

    unary: log odds of good for each line; all chains advance together, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    long = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    steps = int(long[0]) if len(long) else 0
    psi = np.stack([1 / (1 + np.exp(np.clip(unary, -30, 30))), 1 / (1 + np.exp(-np.clip(unary, -30, 30)))], axis=1)
    a, alpha, beta = np.exp(trans), np.empty_like(psi), np.empty_like(psi)
    live = np.searchsorted(-long, -np.arange(steps), "left")  # chains longer than t
    for t in range(steps):
        at = start[: live[t]] + t
        v = psi[at] if t == 0 else psi[at] * (alpha[at - 1] @ a)
        alpha[at] = v / v.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        at = start[: live[t]] + t
        beta[at] = 1.0
        if t + 1 < steps and live[t + 1]:
            on = at[: live[t + 1]]
            nxt = psi[on + 1] * beta[on + 1]
            v = nxt @ a.T
            beta[on] = v / v.sum(axis=1, keepdims=True)
            both = alpha[on][:, :, None] * a[None] * nxt[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    m = alpha * beta
    return m[:, 1] / m.sum(axis=1), pairs


def train_field(x: np.ndarray, good: np.ndarray, counts: np.ndarray, rounds: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the conditional likelihood of the lines' labels (Adam)."""
    starts = np.zeros(len(x), bool)
    starts[(np.cumsum(counts) - counts)[counts > 0]] = True
    on = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[on - 1].astype(int), good[on].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        marginal, pairs = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), counts)
        g = np.concatenate([x.T @ (good - marginal), (seen - pairs).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def weighted_mean(marginal: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean marginal of each text, lines weighted by length; 0 for a text without lines."""
    at = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(at, size, len(counts))
    return np.bincount(at, size * marginal, len(counts)) / np.maximum(total, 1)


class QualityModel:
    """The field and the curve from mean marginals to scores."""

    def __init__(self, own: np.ndarray, size: np.ndarray, counts: np.ndarray, label: np.ndarray):
        self.constant = None
        if len(set(label.tolist())) < 2:
            self.constant = float(label[0]) if len(label) else 1.0
            return
        x = with_neighbours(own, counts).astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.mean[self.scale < 1e-9], self.scale[self.scale < 1e-9] = 0, 1  # keeps the constant
        x = (x - self.mean) / self.scale
        doc = np.repeat(np.arange(len(counts)), counts)
        good = label[doc].astype(float)
        self.weights, self.trans = train_field(x, good, counts)
        marginal, _ = forward_backward(x @ self.weights, self.trans, counts)
        bad = label[doc] == 0
        worst = np.full(len(counts), np.inf)
        np.minimum.at(worst, doc, marginal)
        good[bad] = (marginal > np.maximum(0.5, worst[doc]))[bad]
        self.weights, self.trans = train_field(x, good, counts)
        m = weighted_mean(forward_backward(x @ self.weights, self.trans, counts)[0], size, counts)
        z, self.curve = np.stack([np.ones_like(m), m], axis=1), np.zeros(2)
        for _ in range(50):  # Newton steps of a logistic regression
            p = 1 / (1 + np.exp(-z @ self.curve))
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
            self.curve = self.curve + np.linalg.solve(h, z.T @ (label - p) - 1e-3 * self.curve)

    def line_marginals(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good for each line, line lengths, and lines of each text."""
        own, size, counts = line_features(texts)
        if self.constant is not None:
            return np.full(len(own), self.constant), size, counts
        x = (with_neighbours(own, counts) - self.mean) / self.scale
        return forward_backward(x @ self.weights, self.trans, counts)[0], size, counts

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and the number of its lines that are bad."""
        marginal, size, counts = self.line_marginals(texts)
        mean = weighted_mean(marginal, size, counts)
        bad = np.bincount(np.repeat(np.arange(len(counts)), counts), marginal < 0.5, len(counts)).astype(np.int64)
        if self.constant is None:
            mean = np.where(counts > 0, 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * mean))), 0.0)
        return np.where(counts > 0, mean, 0.0), bad


def is_held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lines: int = LINES) -> QualityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, quality).

    The driver gets features of at most 4 * per_class rows of at most lines lines, 68 bytes a line.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    share = F.lit(0.0)
    for row in usable.groupBy("quality").count().collect():
        share = F.when(F.col("quality") == row["quality"], min(1.0, 1.2 * per_class / row["count"] + 20 / row["count"])).otherwise(share)
    near = usable.withColumn("order", F.xxhash64("doc_id", F.lit(5))).where(F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) < share)
    # about 1.2 * per_class rows of either label, whatever the corpus: small enough to broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(near), "doc_id")

    def run(batches):
        for b in sliced(batches):
            own, size, counts = line_features(b.column("text").to_pylist())
            ends = np.cumsum(counts)
            at = np.flatnonzero((counts > 0) & (counts <= lines))
            b = b.take(pa.array(at))
            parts = [(own[e - c : e].tobytes(), size[e - c : e].tobytes()) for c, e in zip(counts[at], ends[at])]
            yield pa.record_batch([b.column("order"), b.column("quality").cast(pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["order", "quality", "own", "size"])

    found = rows.select("order", "quality", "text").mapInArrow(run, "order bigint, quality int, own binary, size binary")
    # repeated rows of an id have one hash, so that only their number is unknown before
    found = found.orderBy("order", "quality", "own", "size").limit(4 * per_class).collect()
    kept, seen = [], {0: 0, 1: 0}
    for row in found:
        if seen[row["quality"]] < per_class:
            seen[row["quality"]] += 1
            kept.append(row)
    own = np.frombuffer(b"".join(r["own"] for r in kept), np.float32).reshape(-1, OWN)
    size = np.frombuffer(b"".join(r["size"] for r in kept), np.float64)
    return QualityModel(own, size, np.array([len(r["size"]) // 8 for r in kept], np.int64), np.array([r["quality"] for r in kept], np.int64))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with quality_score and bad_lines (or free_names of these), for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = free_names(docs, *COLUMNS)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType())])

    def run(batches):
        for b in sliced(batches):
            s, bad = shared.value.score(b.column("text").to_pylist())
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64()), pa.array(bad, pa.int64())], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"), "bad_lines")


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
