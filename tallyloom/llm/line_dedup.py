"""Line deduplication by range-partitioned hashes and keep bitmaps.

A line's key is the line without white space around it, A-Z lower-cased. The 128-bit
hashes of all keys that are long enough are dealt into ranges of (hash, document,
position) and sorted within them, documents descending. Each range is then streamed: the
first document of a hash is the one that keeps the line, and once ``least_docs``
documents were seen, all other occurrences go. As the document is part of the range
key, a line of a third of all documents is spread over as many ranges as its rows fill.
Only the first and the last hash of a range can go on in another one; of these a range
returns up to ``least_docs`` documents, so that all of them together are at most two
hashes a range, and are broadcast.

keep_bitmaps() returns, instead of texts, one compressed bitmap for each document that
loses lines. dedup_lines() applies them: texts move once at most, to meet their bitmap.

Keys are compared by 128-bit hashes only: two different keys in n have the same hash with
a probability of n * n / 2 ** 129.

Defined results: null and empty texts are one empty line; a null doc_id is a document
below all others; rows with one doc_id are one document, in which lines count once and
whose rows all keep theirs; very long texts are hashed and joined whole; there are no
ties, since the largest doc_id is one; extra columns are kept, and a new column whose
name is taken gets an underscore; an empty table gives none. ids are of any type that
sorts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_names, materialize, partitions, sliced, table

LEAST_CHARS, LEAST_DOCS = 20, 3
BLANKS = b" \t\n\x0b\x0c\r"
ROWS = 4_000_000  # lines in a range, about
SEEN = 100_000  # rows that a task remembers, so that repeated ones are hashed once
GONE, OPEN, WITNESS = 0, 1, 2  # a line that goes; one that its hash's other ranges decide; a document that has the hash
NAMES = ["kind", "h1", "h2", "doc_id", "t", "pos"]


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The key of a line; None if it is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < least_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return key


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h1, h2, doc_id, t, pos of every line that counts; t is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[tuple] = set()
        for b in sliced(batches):
            row, pos, found = [], [], []
            for i, (doc_id, t, text) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                if (doc_id, t) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((doc_id, t))
                for k, line in enumerate(text.split(b"\n")):
                    if len(line) >= least_chars and (key := line_key(line, least_chars)) is not None:
                        row.append(i)
                        pos.append(k)
                        found.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32())], NAMES[1:])

    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, t bigint, pos int")


def steps(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before (nulls are equal); the first one doesn't."""
    out = np.zeros(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = unlike | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def marked(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(rows.num_rows, kind, np.int8)), *rows.columns], NAMES)


class Going:
    """The hash that the stream has reached, whose rows may go on in the next batch."""

    def __init__(self, first: bool, least: int):
        self.first, self.least, self.most = first, least, max(2, least)  # first: of this range, so that the range before may have it too
        self.docs: pa.Array | None = None  # up to most documents, largest first
        self.waiting: list[pa.RecordBatch] = []  # rows of the second to last-but-one of them

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = rows.column(2)
        new = steps(ids if self.docs is None else pa.concat_arrays([self.docs.slice(len(self.docs) - 1), ids]))
        if self.docs is None:
            new[0] = True
        elif len(self.docs) < self.most:
            new = new[1:]
        else:
            new = np.zeros(len(ids), bool)
        known = 0 if self.docs is None else len(self.docs)
        at = np.flatnonzero(new)[: self.most - known]
        fresh = ids.take(pa.array(at))
        self.docs = fresh if self.docs is None else pa.concat_arrays([self.docs, fresh])
        if self.first:
            yield marked(OPEN, rows)
            return
        if len(self.docs) == 1:
            return
        rest = rows.slice(int(at[1 - known])) if known < 2 else rows  # without those of the first document
        if len(self.docs) < self.least:
            self.waiting.append(rest)
        else:
            yield from (marked(GONE, r) for r in [*self.waiting, rest])
            self.waiting = []

    def end(self, key: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        """last: of this range, so that the next one may have it too. key: a row of the hash."""
        if not (self.first or last):
            return
        n = len(self.docs)
        yield pa.record_batch([pa.array([WITNESS] * n, pa.int8()), *(pa.concat_arrays([c] * n) for c in key.columns[:2]), self.docs, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], NAMES)
        yield from (marked(OPEN, r) for r in self.waiting)


def streamed(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of a range sorted by hash, document (descending), text and position: what goes, what is open, and who has the open hashes."""
    going, key = None, None
    for b in batches:
        if not b.num_rows:
            continue
        other = steps(b.column(0)) | steps(b.column(1))
        starts = np.flatnonzero(other)
        if key is not None and not (key.column(0)[0] == b.column(0)[0] and key.column(1)[0] == b.column(1)[0]):
            starts = np.concatenate([[0], starts])
        head = int(starts[0]) if len(starts) else b.num_rows
        if head:  # goes on with the hash before, or begins the range
            going = going or Going(True, least)
            yield from going.take(b.slice(0, head))
            key = b.slice(0, 1)
        if not len(starts):
            continue
        yield from going.end(key, False)
        tail = int(starts[-1])
        if tail > head:  # hashes that lie within this batch
            own, first = b.slice(head, tail - head), starts[:-1] - head
            new = steps(own.column(2))
            new[first] = True
            nth, group = np.cumsum(new), np.zeros(len(new), np.int64)
            group[first[1:]] = 1
            group = np.cumsum(group)
            gone = (np.add.reduceat(new, first, dtype=np.int64) >= least)[group] & (nth > nth[first][group])
            same = ~(new | steps(own.column(3)) | steps(own.column(4)))  # repeated rows of a document
            yield marked(GONE, own.filter(pa.array(gone & ~same)))
        going, key = Going(False, least), b.slice(tail, 1)
        yield from going.take(b.slice(tail))
    if going is not None:
        yield from going.end(key, True)


def bitmap(positions: np.ndarray) -> bytes:
    """Which lines stay: bit k of the (little-endian) bytes is line k; lines beyond them stay."""
    keep = np.ones(int(positions.max()) // 8 * 8 + 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def kept_lines(lines: list[bytes], keep: bytes | None) -> list[bytes]:
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [line for k, line in enumerate(lines) if k >= len(bits) or bits[k]]


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, rows: int = ROWS) -> DataFrame:
    """doc_id, t, pos of every line that goes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = materialize(hashed_lines(docs, least_chars), "lines")
    parts = max(partitions(docs.sparkSession), -(-lines.count() // rows))
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "t", "pos"]
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = dealt.mapInArrow(lambda it: streamed(it, least_docs), f"kind tinyint, h1 bigint, h2 bigint, doc_id {kind}, t bigint, pos int")
    found = materialize(found, "found")
    witness = found.where(F.col("kind") == WITNESS).select("h1", "h2", "doc_id").distinct()
    # at most two hashes of each range
    spread = witness.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeps"), F.count("*").alias("n")).where(F.col("n") >= least_docs)
    open_ = found.where(F.col("kind") == OPEN).join(F.broadcast(spread), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeps")))
    return found.where(F.col("kind") == GONE).select("doc_id", "t", "pos").union(open_.select("doc_id", "t", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, keep (binary): a row for each document that loses lines; see bitmap()."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            keep = [bitmap(np.array(p, np.int64)) for p in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keep, pa.binary())], ["doc_id", "text_hash", "keep"])

    lost = dropped_lines(docs, least_chars, least_docs, rows).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("pos"))
    return lost.mapInArrow(run, f"doc_id {kind}, text_hash bigint, keep binary")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, rows: int = ROWS) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped (or free_names of these), for every row."""
    maps = materialize(keep_bitmaps(docs, least_chars, least_docs, rows), "bitmaps").withColumnRenamed("doc_id", "id")
    names = free_names(docs, "kept_text", "n_lines", "n_dropped")
    of = [F.col(c) for c in docs.columns]
    whole = docs.select(F.struct(*of).alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("t"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    met = whole.join(maps, F.col("key").eqNullSafe(F.col("id")) & (F.col("t") == F.col("text_hash")), "left").select("row", "bytes", "keep")
    out = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())]

    def run(batches):
        for b in sliced(batches):
            texts, n, lost = [], [], []
            for text, keep in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = text.split(b"\n")
                stay = kept_lines(lines, keep)
                texts.append(b"\n".join(stay))
                n.append(len(lines))
                lost.append(len(lines) - len(stay))
            kept = pa.array(texts, pa.binary()).cast(pa.string(), safe=False) if texts else pa.array([], pa.string())
            yield pa.record_batch([b.column(0), kept, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], ["row", *names])

    found = met.mapInArrow(run, T.StructType([T.StructField("row", docs.schema), *out]))
    return found.select("row.*", *names)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeps FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
judged AS (SELECT doc_id, line, pos, keeps IS NOT NULL AND doc_id <> keeps AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": ORACLE}
