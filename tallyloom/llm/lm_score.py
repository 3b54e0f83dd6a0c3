"""Language-model scores by stupid backoff, from the n-gram counts of the whole corpus.

Every document is scored by a model of all others: its own occurrences are taken off
each count, since with them no n-gram of the corpus would ever be unseen. A word w
after the words c scores count(c w) / count(c) if that n-gram occurs in another
document, else ``backoff`` times its score after one word less; the last resort is
max(count(w), 1) / words of the corpus. Contexts reach back ``order`` - 1 words and
never beyond the text. A document's score is the sum of the logarithms. No n-gram is
left out for being rare or frequent.

Documents are cut into chunks of a bounded number of words, each with its words
numbered. A chunk's n-grams of all orders are exploded and summed in place (so that a
frequent n-gram is one entry of a chunk, however many of its documents have it), and
dealt out by ranges of their 60-bit hash. Each range is one part of the count tables:
its entries are summed by hash, and the sums are joined back to the entries of each
chunk. Chunks meet their counts by chunk number and sum them by document. Entries
travel as compressed blocks, one for each chunk, order and range: sorted hashes as
differences, counts as bytes. Only the sum of all words comes to the driver. Work and blocks grow in
proportion to the texts as long as chunks have many more entries than there are ranges;
raise ``chunk_words`` and ``range_bytes`` together with executor memory (at 100 TB to
about 60 million and 1 GB).

Words are runs of anything but ASCII white space, with A-Z lower-cased.

Defined results: null and empty texts have no words and no score (null); each row is a
document of its own, also where a doc_id repeats or is null, and a repeated row sees
its copy; very long texts are a chunk of their own; there are no ties to break; extra
columns are ignored; an empty table gives none. The input must be deterministic (a scan
is), as its partitions are read again if an executor is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, partitions, sliced, table

BACKOFF, ORDER, CHUNK_WORDS, RANGE_BYTES = 0.4, 3, 1_500_000, 32 << 20
SPARE = 4  # low bits of a hash that are left out, which makes blocks smaller


class _Numbers(dict):
    """Words of a chunk, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest width bytes of unsigned integers: all first bytes, all second ones, ..."""
    return values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int, kind) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(kind)


def pack_counts(n: np.ndarray) -> bytes:
    """A byte each; what does not fit follows in eight."""
    return packed(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes())


def unpack_counts(data: bytes, size: int) -> np.ndarray:
    data = unpacked(data)
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<u8", offset=size).astype(np.int64)
    return n


def pack_keys(keys: np.ndarray) -> tuple[bytes, int]:
    """Sorted keys: the first one, then differences with the bytes that the largest of them needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return packed(keys[:1].tobytes() + planes(steps, width)), width


def unpack_keys(data: bytes, width: int) -> np.ndarray:
    data = unpacked(data)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), from_planes(data[8:], width, np.uint64)]), dtype=np.uint64)


CHUNK = "chunk bigint, ids array<{kind}>, sizes binary, words binary, numbers binary"


def chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """One row for each chunk: doc ids, words in each text, hashes of the words by number, all words as numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        number, ids, sizes, numbers, held = _Numbers(), [], [], [], 0

        def out():
            words = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in number), np.uint64, len(number))
            flat = np.concatenate([*numbers, np.empty(0, np.uint32)])
            every = pa.concat_arrays(ids)
            return pa.record_batch([
                pa.array([base + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
                pa.array([np.array(sizes, "<u8").tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([packed(planes(flat, 4))], pa.binary()),
            ], ["chunk", "ids", "sizes", "words", "numbers"])

        for b in sliced(batches):
            first = 0
            for at, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                numbers.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                sizes.append(len(words))
                held += len(words)
                if held >= chunk_words:
                    ids.append(b.column(0).slice(first, at + 1 - first))
                    yield out()
                    number, ids, sizes, numbers, held, first, made = _Numbers(), [], [], [], 0, at + 1, made + 1
            if first < b.num_rows:
                ids.append(b.column(0).slice(first))
        if ids:
            yield out()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, CHUNK.format(kind=kind))


class Chunk:
    """The texts of a chunk as hashed words."""

    def __init__(self, row: pa.Table | pa.RecordBatch, at: int):
        self.sizes = np.frombuffer(row["sizes"][at].as_py(), "<u8").astype(np.int64)
        words = np.frombuffer(row["words"][at].as_py(), np.uint64)
        self.words = words[from_planes(unpacked(row["numbers"][at].as_py()), 4, np.uint32)]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.start = np.cumsum(self.sizes) - self.sizes

    def ngrams(self, order: int):
        """For each order from 1: where its n-grams end, and their hashes (60 bits)."""
        g = self.words
        for k in range(1, order + 1):
            if k > 1:
                g = g[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.words[k - 1 :]
                g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                g ^= g >> np.uint64(29)
            inside = np.ones(len(g), bool)
            for back in range(1, k):  # not those that reach into the next text
                at = self.start - back
                inside[at[(at >= 0) & (at < len(g))]] = False
            yield np.flatnonzero(inside) + k - 1, g[inside] >> np.uint64(SPARE)


def requests(batches, order: int, ranges: int):
    """range, chunk, width, size, keys, n: the distinct n-grams of each chunk and how often it has them."""
    for b in batches:
        for at in range(b.num_rows):
            chunk = b["chunk"][at].as_py()
            for k, (_, grams) in enumerate(Chunk(b, at).ngrams(order)):
                keys, n = np.unique(grams, return_counts=True)
                cuts = np.searchsorted((keys >> np.uint64(32 - SPARE)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
                rows = [(k * ranges + r, chunk, e - s, *pack_keys(keys[s:e]), pack_counts(n[s:e])) for r, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))], ["range", "chunk", "size", "keys", "width", "n"])


def answer(blocks: pa.Table) -> pa.Table:
    """range, chunk, size, others: of the entries of each block, how often all other chunks have them."""
    keys = [unpack_keys(k, w) for k, w in zip(blocks["keys"].to_pylist(), blocks["width"].to_pylist())]
    sizes = blocks["size"].to_pylist()
    count = np.concatenate([unpack_counts(c, size) for c, size in zip(blocks["n"].to_pylist(), sizes)])
    every = np.concatenate(keys)
    order = np.argsort(every)
    new = np.diff(every[order], prepend=~every[order[0]]) != 0
    sums = np.add.reduceat(count[order], np.flatnonzero(new))  # this range of the count tables
    others = np.empty_like(count)
    others[order] = sums[np.cumsum(new) - 1]
    others -= count
    out = [pack_counts(o) for o in np.split(others, np.cumsum(sizes)[:-1])]
    return pa.table({"range": blocks["range"], "chunk": blocks["chunk"], "size": blocks["size"], "others": pa.array(out, pa.binary())})


def elsewhere(grams: np.ndarray, doc: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs outside its document: others, of the distinct ones in order, and those in this chunk's other documents."""
    order = np.argsort(grams, kind="stable")  # equal n-grams by document, as these follow each other
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    del grams
    starts = np.flatnonzero(new)
    n = np.diff(starts, append=len(new))
    count = np.repeat(others + n, n)
    new[1:] |= doc[1:] != doc[:-1]
    starts = np.flatnonzero(new)
    n = np.diff(starts, append=len(new))
    count -= np.repeat(n, n)
    out = np.empty_like(count)
    out[order] = count
    return out


def summed(chunk: pa.Table, answers: pa.Table, order: int, ranges: int, backoff: float) -> pa.Table:
    """doc_id, n_words, backed_off, value, last: scores without the number of all words, by which the last ones are still to be divided."""
    c = Chunk(chunk.combine_chunks(), 0)
    size, docs = len(c.words), len(c.sizes)
    value, last, backed, before = np.zeros(size), np.ones(size, bool), np.zeros(size, bool), None
    answers = sorted(zip(*(answers[x].to_pylist() for x in ("range", "size", "others"))), key=lambda a: a[0])
    for k, (ends, grams) in enumerate(c.ngrams(order)):
        others = np.concatenate([np.empty(0, np.int64), *(unpack_counts(o, s) for r, s, o in answers if r // ranges == k)])
        count = elsewhere(grams, c.doc[ends], others)
        logs = np.zeros(size)
        logs[ends] = np.log(np.maximum(count, 1))
        if k == 0:
            value[:] = logs
        else:
            seen = count > 0
            value[ends] = np.where(seen, logs[ends] - before[ends - 1], np.log(backoff) + value[ends])
            last[ends[seen]] = False
            backed[ends] = ~seen
        before = logs
    backed, value, last = (np.bincount(c.doc, v, docs) for v in (backed, value, last))
    ids = chunk["ids"].combine_chunks().flatten()
    return pa.table({"doc_id": ids, "n_words": pa.array(c.sizes), "backed_off": pa.array(backed.astype(np.int64)), "value": pa.array(value.astype(np.float64)), "last": pa.array(last.astype(np.int64))})


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_words, backed_off (words whose longest context has not been seen before them elsewhere), log_score."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(partitions(spark), size // range_bytes)
    every = chunks(docs, chunk_words).repartition(max(partitions(spark), size // range_bytes), "chunk")
    blocks = every.mapInArrow(lambda it: requests(it, order, ranges), "range bigint, chunk bigint, size bigint, keys binary, width int, n binary")
    answers = blocks.groupBy("range").applyInArrow(answer, "range bigint, chunk bigint, size bigint, others binary")
    out = every.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda left, right: summed(left, right, order, ranges, backoff), f"doc_id {kind}, n_words bigint, backed_off bigint, value double, last bigint"
    )
    out = materialize(out, "scores")
    total = out.agg(F.sum("n_words").alias("total"))
    score = F.col("value") - F.col("last") * F.log(F.col("total"))
    return out.crossJoin(F.broadcast(total)).select("doc_id", "n_words", "backed_off", F.when(F.col("n_words") > 0, F.round(score, 4)).alias("log_score"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
words AS (SELECT r, unnest(ws) AS z, generate_subscripts(ws, 1) AS i FROM docs),
toks AS (SELECT *, lag(z) OVER o AS y, lag(z, 2) OVER o AS x FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
d1 AS (SELECT r, z, count(*) AS own, sum(count(*)) OVER (PARTITION BY z) - count(*) AS n FROM toks GROUP BY r, z),
d2 AS (SELECT r, y, z, sum(count(*)) OVER (PARTITION BY y, z) - count(*) AS n FROM toks WHERE y IS NOT NULL GROUP BY r, y, z),
d3 AS (SELECT r, x, y, z, sum(count(*)) OVER (PARTITION BY x, y, z) - count(*) AS n FROM toks WHERE x IS NOT NULL GROUP BY r, x, y, z),
scored AS (
  SELECT toks.r, (toks.y IS NOT NULL AND d2.n = 0) OR (toks.x IS NOT NULL AND d3.n = 0) AS off,
         CASE WHEN d3.n > 0 THEN ln(d3.n / cx.n)
              ELSE CASE WHEN toks.x IS NOT NULL THEN ln({BACKOFF}) ELSE 0 END + CASE WHEN d2.n > 0 THEN ln(d2.n / cy.n)
              ELSE CASE WHEN toks.y IS NOT NULL THEN ln({BACKOFF}) ELSE 0 END + ln(greatest(d1.n, 1) / (SELECT count(*) FROM toks)) END END AS s
  FROM toks JOIN d1 ON d1.r = toks.r AND d1.z = toks.z
  LEFT JOIN d1 cy ON cy.r = toks.r AND cy.z = toks.y
  LEFT JOIN d2 ON d2.r = toks.r AND d2.y = toks.y AND d2.z = toks.z
  LEFT JOIN d2 cx ON cx.r = toks.r AND cx.y = toks.x AND cx.z = toks.y
  LEFT JOIN d3 ON d3.r = toks.r AND d3.x = toks.x AND d3.y = toks.y AND d3.z = toks.z)
SELECT docs.doc_id AS doc_id, count(s)::BIGINT AS n_words, count(*) FILTER (off)::BIGINT AS backed_off, round(sum(s), 4) AS log_score
FROM docs LEFT JOIN scored USING (r) GROUP BY docs.r, docs.doc_id"""

QUERIES = {"op2_stupid_backoff": op2_stupid_backoff}
ORACLES = {"op2_stupid_backoff": ORACLE}
