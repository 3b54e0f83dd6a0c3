"""Spelling variants by PartEnum signatures of letter multisets.

Two words are near if one code point is inserted, deleted or replaced. Take their letter
multisets as binary vectors (one dimension for the first a, one for the second a, and so
on): words of one length then differ in exactly two dimensions, words of lengths L and
L + 1 in one. Dimensions are dealt by hash into ``parts`` parts, and the parts that an edit
doesn't touch agree: for words of one length all but some two, else all but some one.
Each choice of parts left out gives a signature: the letters in the others, and the
shorter word's length. Near words share a signature for certain; words are met by an
equality join of signatures and then compared letter by letter. Which choice it is follows
from the letters that differ, so that a pair is returned once.

In a group, words are only compared with those that are alike before or after the middle,
since one edit leaves one of the halves as it is. Of a signature that more than ``crowd``
words share (frequent letters, anagrams), the halves become part of the join key, so that
no task gets all of it. Work so grows with words and near pairs, not with the square of a
group.

Words are counted by tasks before the shuffle. A word's form is its near word of largest
count, if that is at least twice its own; roots follow forms by doubling steps, so that
a chain of any length takes its logarithm of rounds, each written to the shared folder.

Defined results: null and empty texts have no words; a null doc_id counts as the empty
string; repeated rows count each; very long texts and words are taken whole; of equal
counts the form smallest in code-point order is taken; extra columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, sliced, table

LEAST_CHARS, LEAST_COUNT, MANY_TIMES = 5, 3, 2
TYPOS = 97  # a run whose hash that divides loses a code point
PARTS = 5
CROWD = 1000  # words of a signature that are not dealt out by halves
FEW = 200_000  # crowded signatures that are broadcast, counted first
HELD = 400_000  # words that a task counts before it passes them on


def runs_of(text: str, least: int = LEAST_CHARS) -> Counter[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least so many code points, A-Z lower-cased, in Latin-1."""
    return Counter(re.findall(rb"[a-z\xc0-\xff]{%d,}" % least, text.encode("latin-1", "replace").lower()))


def count_words(held: dict[bytes, int], doc_id: str, text: str, least: int = LEAST_CHARS, typos: int = TYPOS) -> None:
    """Add a text's words (in Latin-1) to held; of some runs a code point is deleted. Shorter runs have no word that counts."""
    begun, crc, get = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32, held.get
    for run, n in runs_of(text, least).items():
        h = crc(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if not h % typos:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        held[run] = get(run, 0) + n


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typos: int = TYPOS) -> DataFrame:
    """word, n of all words that are long and frequent enough."""

    def count(batches):
        held: dict[bytes, int] = {}

        def out():
            words = [w for w in held if len(w) >= least_chars]
            return pa.record_batch([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                count_words(held, doc_id, text, least_chars, typos)
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string")).where("text is not null")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Cells(dict):
    """(letter, how many of it came before), a dimension -> part and 64-bit hash."""

    def __init__(self, parts: int = PARTS):
        self.parts = parts
        self.pairs = list(combinations(range(parts), 2))  # left out for words of one length; one part for the others
        self.kind = {p: k for k, p in enumerate(self.pairs)}

    def __missing__(self, cell: tuple[str, int]) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(f"{cell[0]}{cell[1]}".encode("utf-8", "surrogatepass"), 3)
        self[cell] = found = (h % self.parts, h)
        return found

    def sums(self, word: str) -> list[int]:
        """The sum of the hashes of a word's dimensions in each part."""
        sums, before = [0] * self.parts, {}
        for c in word:
            k = before.get(c, 0)
            before[c] = k + 1
            part, h = self[c, k]
            sums[part] += h
        return [x & (2**64 - 1) for x in sums]

    def signatures(self, words: list[str]) -> np.ndarray:
        """A row for each word: its 64-bit signatures of each pair of parts left out, then of each single part."""
        sums = np.array([self.sums(w) for w in words], np.uint64).reshape(len(words), self.parts)
        total = sums.sum(axis=1, dtype=np.uint64)
        out = [total - sums[:, p] - sums[:, q] for p, q in self.pairs] + [total - sums[:, p] for p in range(self.parts)]
        return np.stack([x * np.uint64(0x9E3779B97F4A7C15) for x in out], axis=1).view(np.int64)

    def kind_of(self, a: str, b: str) -> int:
        """The signature by which two near words (a not the longer) are returned: the first one that leaves out what differs."""
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        q = self[b[k], b.count(b[k]) - 1][0]
        if len(a) < len(b):
            return len(self.pairs) + q
        p = self[a[k], a.count(a[k]) - 1][0]
        return self.kind[min(p, q), max(p, q)] if p != q else self.kind[(p, p + 1) if p == 0 else (0, p)]


def is_near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def halves(word: str, short: int) -> tuple[str, str]:
    """What an edit of a pair, of which the shorter one has short letters, leaves alone on one side."""
    return word[: short // 2], word[len(word) - (short - short // 2) :]


KEY = ["kind", "sig", "short", "half"]


def groups_of(batches) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal KEY, of a sorted stream; about a batch each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in KEY]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(c[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py() for k, c in zip(KEY, cols)):
            cuts = np.concatenate([[0], cuts])
        if len(cuts):
            last = int(cuts[-1])
            whole = [*held, b.slice(0, last)]
            held = [b.slice(last)]
            if sum(x.num_rows for x in whole):
                yield pa.Table.from_batches(whole)
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def candidates(group: np.ndarray, half: np.ndarray, short: np.ndarray, size: np.ndarray, same_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group with equal halves; of unlike lengths where the group isn't one of a single length."""
    order = np.lexsort((half, group))
    new = (group[order][1:] != group[order][:-1]) | (half[order][1:] != half[order][:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]])
    many = np.flatnonzero(np.diff(starts) > 1)
    left, right = [], []
    for lo, hi in zip(starts[many].tolist(), starts[many + 1].tolist()):
        rows = order[lo:hi]
        if same_length[rows[0]]:
            i, j = np.triu_indices(hi - lo, 1) if hi - lo > 2 else ([0], [1])
            left.append(rows[i])
            right.append(rows[j])
        else:
            a, b = rows[size[rows] == short[rows]], rows[size[rows] != short[rows]]
            if len(a) and len(b):
                left.append(np.repeat(a, len(b)))
                right.append(np.tile(b, len(a)))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def compared(batches, parts: int):
    """Sorted rows (KEY, word, n): word, other, other_n of near pairs, in both directions, each pair by one of its signatures."""
    cells = Cells(parts)
    one_length = len(cells.pairs)
    for t in groups_of(batches):
        kind, sig, short, key_half = (t.column(k).to_numpy() for k in KEY)
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        new = np.zeros(len(kind), np.int64)
        new[1:] = (kind[1:] != kind[:-1]) | (sig[1:] != sig[:-1]) | (short[1:] != short[:-1]) | (key_half[1:] != key_half[:-1])
        group, size = np.cumsum(new), np.fromiter(map(len, words), np.int64, len(words))
        alone = np.bincount(group)[group] == 1
        if alone.all():
            continue
        cut = (short // 2).tolist()
        heads = np.fromiter((hash(w[:k]) for w, k in zip(words, cut)), np.int64, len(words))
        tails = np.fromiter((hash(w[k - s :]) for w, k, s in zip(words, cut, short.tolist())), np.int64, len(words))
        found: set[tuple[int, int]] = set()
        for half in (heads, tails):
            left, right = candidates(group, half, short, size, kind < one_length)
            for i, j, k in zip(left.tolist(), right.tolist(), kind[left].tolist()):
                a, b = words[i], words[j]
                if is_near(a, b) and cells.kind_of(a, b) == k and (i, j) not in found and (j, i) not in found:
                    side = key_half[i]
                    if not side or side == half_key(a, int(short[i]), first_half(a, b, int(short[i]))):
                        found.add((i, j))
        if found:
            i, j = (np.array(x) for x in zip(*found))
            a, b = [words[k] for k in i.tolist()], [words[k] for k in j.tolist()]
            yield pa.record_batch([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(np.concatenate([n[j], n[i]]))], ["word", "other", "other_n"])


def half_key(word: str, short: int, side: int) -> int:
    """A number other than 0 for a half of a word."""
    return xxhash.xxh64_intdigest(halves(word, short)[side].encode("utf-8", "surrogatepass"), side) >> 2 | 1


def first_half(a: str, b: str, short: int) -> int:
    """The first of the halves that both words have: by its key they are returned."""
    return 0 if halves(a, short)[0] == halves(b, short)[0] else 1


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """kind, sig, short, word, n: a row for each signature of a word; short is the length of the shorter word of a pair."""

    def run(batches):
        cells = Cells(parts)
        pairs = len(cells.pairs)
        kinds = np.array([*range(pairs), *range(pairs, pairs + parts), *range(pairs, pairs + parts)], np.int32)
        less = np.array([0] * (pairs + parts) + [1] * parts, np.int32)  # as the shorter one, or of equal length; then as the longer one
        for b in sliced(batches, 2000):
            found = b.column("word").to_pylist()
            size = np.fromiter(map(len, found), np.int32, len(found))
            at = pa.array(np.repeat(np.arange(len(found)), len(kinds)))
            sigs = cells.signatures(found)[:, kinds] if found else np.empty(0, np.int64)
            short = (size[:, None] - less[None, :]).ravel()
            yield pa.record_batch([pa.array(np.tile(kinds, len(found))), pa.array(sigs.ravel()), pa.array(short), b.column("word").take(at), b.column("n").take(at)], ["kind", "sig", "short", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "kind int, sig bigint, short int, word string, n bigint")


def near_words(words: DataFrame, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """word, other, other_n: each pair of near words of words (word, n) twice, once from each side."""

    def halved(batches):
        for b in sliced(batches, 2000):
            found, short = b.column("word").to_pylist(), b.column("short").to_pylist()
            at = pa.array(np.repeat(np.arange(len(found)), 2))
            half = np.array([half_key(w, s, side) for w, s in zip(found, short) for side in (0, 1)], np.int64)
            yield pa.record_batch([*(b.column(c).take(at) for c in KEY[:3]), pa.array(half), b.column("word").take(at), b.column("n").take(at)], [*KEY, "word", "n"])

    rows, key = signed(words, parts), KEY[:3]
    crowded = materialize(rows.groupBy(*key).agg(F.count("*").alias("words")).where(F.col("words") > crowd).select(*key), "crowded")
    if many := crowded.count():
        known = F.broadcast(crowded) if many <= FEW else crowded
        split = rows.join(known, key, "left_semi").mapInArrow(halved, "kind int, sig bigint, short int, half bigint, word string, n bigint")
        rows = rows.join(known, key, "left_anti").select(*key, F.lit(0).cast("bigint").alias("half"), "word", "n").union(split)
    else:
        rows = rows.select(*key, F.lit(0).cast("bigint").alias("half"), "word", "n")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(lambda it: compared(it, parts), "word string, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of forms (word, form): the last word on the way from form to form."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        to = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(now.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = MANY_TIMES, typos: int = TYPOS, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs."""
    words = materialize(word_counts(docs, least_chars, least_count, typos), "words")
    near = near_words(words, parts, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    joined = words.join(near, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    found = materialize(joined.select(
        "word", F.when(F.col("is_form"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "forms")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling": op13_spelling}
ORACLES: dict[str, str] = {}
