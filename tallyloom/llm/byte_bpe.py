"""Byte-level BPE by Spark higher-order functions.

Texts are cut into pieces (common.PIECE) that encode independently. Each distinct piece
of the corpus that occurs more than once is folded once, up to a bounded number of the
most frequent ones; their ids are written to the shared folder, and every worker holds
them by sorted hashes. A piece that occurs
once (or, in corpora that exceed the bound, one beyond it) is folded where it stands,
once for each document. Both go through one column expression, bpe(): all runs of bytes
of a match that are tokens, in order of their rank, are folded over a bit mask of the
piece's boundaries. A run becomes a token if both its ends still are boundaries and one
boundary is left between them, which then goes. Ranks come from a literal table in the
plan, found by 64-bit hash.

Most runs of bytes are no tokens, and a look at the table costs more than all else. So the
tasks that hand pieces over also say which runs are worth it (Runs): those within a match of
the pattern whose short hash is that of any token. No token is missed; the few runs
that only share a short hash have no rank in the table.

One pass in order of rank merges as repeated merging of the lowest pair does, provided
that every token is the last merge of its own bytes; RankMap makes sure of that.

A mask holds 62 bytes of a piece. Longer pieces (long words, URLs, keys) are merged in Python with a
heap, in n log n, as no array fold over them stays linear.

Decoding concatenates the vocabulary's byte strings, as a column expression.

Texts are never shuffled; only piece counts are, summed before the shuffle.

Defined results: null and empty texts have no ids; repeated rows are encoded each; a
null doc_id is carried along; very long texts and words take time in proportion to their
length (words: and its logarithm); there are no ties, the leftmost of equal pairs merges
first; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import PIECE, file_system, materialize, sliced, table, worker_cache, write_shared

FREQUENT = 1_500_000  # folded pieces that a worker holds, some 25 bytes each
BITS = 62  # bytes of a piece folded as a bit mask
SLOTS = 22  # bits of the short hash by which runs of bytes are sifted
NO_RANK = 2**31 - 1
SIFTED = 4096  # pieces whose runs are sifted at a time
WORD = "struct<word: binary, runs: array<smallint>>"
HELD = 300_000  # distinct pieces that a worker counts or numbers before it starts anew


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Byte string -> rank from a rank file; path None: the installed public one for many languages."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int], below: int = NO_RANK) -> list[bytes]:
    """Parts of a word after all merges of a rank under below, lowest rank first, then leftmost."""
    n = len(word)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < n and (rank := ranks.get(word[i : after[after[i]]], NO_RANK)) < below:
            heapq.heappush(heap, (rank, i, after[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = after[i]
        if gone[i] or mid >= n or after[mid] != end:
            continue
        gone[mid], after[i] = 1, end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    return [word[i : after[i]] for i in range(n) if not gone[i]]


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class RankMap:
    """The ranks as a literal array of the plan, with two places for each token: its 64-bit hash, the low bits of which give way to the rank.

    Hash bits above the rank's and a place tell the low bits, so that all 64 are compared.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if odd := next((t for t, r in ranks.items() if len(t) > 1 and len(merge_word(t, ranks, r)) != 2), None):
            raise ValueError(f"the token {odd!r} is not the last merge of its own bytes")
        self.low = max(ranks.values(), default=0).bit_length()
        self.bits = max(4, self.low, (4 * len(ranks)).bit_length())  # at most a quarter to a half is taken
        held: list = [None] * (1 << self.bits)
        for token, rank in ranks.items():
            item = int(np.int64(np.uint64(xxhash.xxh64_intdigest(token, 42)))), rank  # as xxhash64()
            place = self.places(item[0])[0]
            for _ in range(1000):
                item, held[place] = held[place], item
                if item is None:
                    break
                place = sum(self.places(item[0])) - place  # the other place of what was there
            else:
                raise ValueError("the table of ranks is too full")
        self.table = literal([x and (x[0] >> self.low << self.low) + x[1] for x in held])
        # by start * 64 + size of a run: the boundaries within it, and the two at its ends
        runs = [(start, size) if 0 < size and start + size <= BITS else (0, 0) for start in range(64) for size in range(64)]
        self.within = literal([(1 << start + size) - (1 << start + 1) if size > 1 else 0 for start, size in runs])
        self.ends = literal([1 << start | 1 << start + size for start, size in runs])

    def places(self, h: int) -> tuple[int, int]:
        mask = (1 << self.bits) - 1
        return h & mask, (h ^ h >> self.bits) & mask

    def bound(self, use) -> Column:
        """use(rank, within, ends), where rank(hash) is null for what is no token's hash; the literals stand once in the plan."""
        mask, low = F.lit((1 << self.bits) - 1), F.lit((1 << self.low) - 1)

        def find(table_):
            def rank(h):
                at = lambda place: F.get(table_, place.bitwiseAND(mask))
                one, two = at(h), at(h.bitwiseXOR(F.call_function("shiftright", h, F.lit(self.bits))))
                same = lambda entry: right(entry.bitwiseXOR(h), F.lit(self.low)) == 0
                return F.when(same(one), one.bitwiseAND(low)).when(same(two), two.bitwiseAND(low))

            return rank

        return let(self.table, lambda table_: let(self.within, lambda within: let(self.ends, lambda ends: use(find(table_), within, ends))))


def literal(values: list[int | None]) -> Column:
    """A literal array<bigint>, as one text in the plan."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def bpe(words: Column, ranks: RankMap) -> Column:
    """Ids (array<array<int>>) of an array of pieces, struct<word, runs> as Runs gives them."""

    def bpe_word(word, runs, rank, within, ends):
        hashes = F.transform(runs, lambda run: F.xxhash64(F.substring(word, F.call_function("shiftright", run, F.lit(6)) + 1, run.bitwiseAND(F.lit(63)))))
        known = F.sort_array(F.array_compact(F.zip_with(hashes, runs, lambda h, run: rank(h) * 4096 + run)))

        def merged(mask, run):
            """The mask of boundaries after a run of bytes (rank, start, size) has been tried; bit k stands before byte k."""
            at = run.bitwiseAND(F.lit(4095))
            seen, both = mask.bitwiseAND(F.get(within, at)), F.get(ends, at)
            return F.when((F.bit_count(seen) == 1) & (mask.bitwiseAND(both) == both), mask - seen).otherwise(mask)

        def ids(mask):
            starts = F.filter(F.sequence(F.lit(0), F.length(word) - 1), lambda k: F.call_function("getbit", mask, k) == 1)
            # the next boundary is the lowest bit left above this one
            rest = lambda k: right(mask, k + 1)
            size = lambda k: (F.bit_count(rest(k).bitwiseAND(-rest(k)) - 1) + 1).cast("int")
            return F.transform(F.transform(starts, lambda k: F.xxhash64(F.substring(word, k + 1, size(k)))), lambda h: rank(h).cast("int"))

        return F.when(F.length(word) > 0, let(F.aggregate(known, F.lit(-1).cast("bigint"), merged), ids)).otherwise(F.array().cast("array<int>"))

    return ranks.bound(lambda rank, within, ends: F.transform(words, lambda w: bpe_word(w["word"], w["runs"], rank, within, ends)))


class Runs:
    """Which runs of bytes of a piece can be tokens: those within one match of the pattern whose short hash is a token's."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        draw = np.random.default_rng(42)
        self.pattern, self.by_byte, self.factor = pattern, draw.integers(0, 2**64, 256, np.uint64), draw.integers(0, 2**64, 1, np.uint64) | np.uint64(1)
        there = np.zeros(1 << SLOTS, bool)
        self.longest = 1
        for size in sorted({len(t) for t in ranks if 1 < len(t) <= BITS}):
            tokens = np.frombuffer(b"".join(t for t in ranks if len(t) == size), np.uint8).reshape(-1, size)
            h = np.zeros(len(tokens), np.uint64)
            for k in range(size):
                h = h * self.factor + self.by_byte[tokens[:, k]]
            there[self.slot(h)] = True
            self.longest = size
        self.packed = np.packbits(there)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SLOTS)).astype(np.int64)

    def finder(self):
        """A function of a list of pieces, which gives them as structs (WORD); a run is start * 64 + size."""
        there, matches = np.unpackbits(self.packed).view(bool), regex.compile(self.pattern).findall

        def find(pieces: list[str]) -> pa.StructArray:
            cut = [[m.encode("utf-8", "surrogatepass") for m in matches(p)] for p in pieces]
            words = [b"".join(c) for c in cut]
            sizes = np.fromiter((len(m) for c in cut for m in c), np.int64)
            each = np.fromiter(map(len, words), np.int64, len(words))
            starts, total = np.cumsum(each) - each, int(each.sum())
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # bytes up to the match's end
            value = self.by_byte[np.frombuffer(b"".join(words), np.uint8)]
            found = np.zeros((total, self.longest + 1), bool)
            at, h = np.arange(total), value
            for size in range(2, self.longest + 1):
                more = left[at] >= size
                at = at[more]
                if not len(at):
                    break
                h = h[more] * self.factor + value[at + size - 1]
                found[at, size] = there[self.slot(h)]
            at, size = np.nonzero(found)
            runs = (at - np.repeat(starts, each)[at]) * 64 + size
            ends = np.searchsorted(at, np.append(starts, total))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(runs.astype(np.int16)))
            return pa.StructArray.from_arrays([pa.array(words, pa.binary()), lists], ["word", "runs"])

        return lambda pieces: pa.concat_arrays([find(pieces[k : k + SIFTED]) for k in range(0, max(len(pieces), 1), SIFTED)])


def joined(ids: Column, strings: list[bytes]) -> Column:
    """The byte strings of an array of ids, one after the other (binary)."""
    table_ = F.from_json(F.lit(json.dumps([s.hex() for s in strings])), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda k: F.get(table_, k)), ""))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The text's bytes of a column of ids (array<int>)."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return joined(ids, tokens)


def little_endian(ids: Column, ranks: dict[bytes, int]) -> Column:
    """A column of ids as little-endian unsigned 32-bit integers."""
    return joined(ids, [k.to_bytes(4, "little") for k in range(max(ranks.values(), default=-1) + 1)])


def piece_counts(docs: DataFrame) -> DataFrame:
    """piece, n: how often each piece of any text occurs."""

    def count(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "n"])

        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                if text:
                    held.update(PIECE.findall(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(docs: DataFrame, most: int) -> DataFrame:
    """The repeated pieces, most of them at most, those with the highest counts (equal counts stay together)."""
    counts = materialize(piece_counts(docs).where("n > 1"), "counts")
    level = F.floor(F.log2("n") * 16)
    total, cut = 0, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred rows
        total += row["count"]
        if total > most:
            cut = row["level"] + 1
            break
    return counts.where(level >= cut).where(F.octet_length("piece") <= BITS).select("piece")


def digests(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the pieces' hashes."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for p in pieces), ">u8").reshape(-1, 2)
    return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint32)


class Folded:
    """Ids of the frequent pieces, found by hash."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        parts = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), b"")]
        for b in pads.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["key", "check", "ids"], batch_readahead=1, fragment_readahead=1):
            if b.num_rows:
                ends = np.frombuffer(b["ids"].buffers()[1], np.int32)[b["ids"].offset : b["ids"].offset + b.num_rows + 1]
                parts.append((b["key"].to_numpy(), b["check"].to_numpy(), np.diff(ends).astype(np.int64) // 4, b["ids"].buffers()[2].to_pybytes()[ends[0] : ends[-1]]))
        key, check, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
        key = key.view(np.uint64)
        order = np.argsort(key)
        self.key, self.check = key[order], check.view(np.uint32)[order]
        starts = (np.cumsum(size) - size)[order]
        size = size[order]
        self.ids = np.frombuffer(b"".join(p[3] for p in parts), "<i4")[slices(starts, size)]
        self.ends = np.concatenate([[0], np.cumsum(size)])

    def find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids start, and how many there are (0: not among them)."""
        key, check = digests(pieces)
        if not len(self.key) or not len(key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = (self.key[at] == key) & (self.check[at] == check)
        return np.where(there, self.ends[at], 0), np.where(there, self.ends[at + 1] - self.ends[at], 0)


CACHE = "folded pieces"
_held: dict[str, Folded] = worker_cache(CACHE)


def held(uri: str) -> Folded:
    """The folded pieces, read once by each worker from the shared folder."""
    if uri not in _held:
        _held.clear()
        _held[uri] = Folded(uri)
    return _held[uri]


class _Numbers(dict):
    """Pieces, numbered as they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = found = len(self)
        return found


def slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, size of them, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    spark = docs.sparkSession
    rank_map, runs = RankMap(ranks), spark.sparkContext.broadcast(Runs(ranks, pattern))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sifted(batches):
        find = runs.value.finder()
        for b in sliced(batches, 10_000):
            yield pa.record_batch([b["piece"], find(b["piece"].to_pylist())], ["piece", "word"])

    def packed(batches):
        for b in batches:
            key, check = digests(b["piece"].to_pylist())
            ids = [np.array(x, "<i4").tobytes() for x in b["ids"].to_pylist()]
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(check.view(np.int32)), pa.array(ids, pa.binary())], ["key", "check", "ids"])

    folded = frequent_pieces(docs, frequent).repartition("piece").mapInArrow(sifted, f"piece string, word {WORD}")
    folded = folded.select("piece", F.element_at(bpe(F.array("word"), rank_map), 1).alias("ids"))
    known = write_shared(folded.mapInArrow(packed, "key bigint, check int, ids binary"), "folded")
    all_ranks = spark.sparkContext.broadcast(ranks)
    names = ["doc_id", "parts", "which", "rare", "merged"]

    def long_word(piece: str) -> list[int] | None:
        if len(piece.encode("utf-8", "surrogatepass")) <= BITS:
            return None
        return [all_ranks.value[t] for w in regex.findall(pattern, piece) for t in merge_word(w.encode("utf-8", "surrogatepass"), all_ranks.value)]

    def look_up(batches):
        number, start, size, table_, find = _Numbers(), np.empty(0, np.int64), np.empty(0, np.int64), held(known), runs.value.finder()
        for b in sliced(batches, keep=CACHE):
            if len(number) > HELD:
                number, start, size = _Numbers(), start[:0], size[:0]
            before = len(number)
            numbers = [np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces)) for pieces in (PIECE.findall(t) if t else [] for t in b.column(1).to_pylist())]
            every = list(number)
            s, n = table_.find(every[before:])
            start, size = np.concatenate([start, s]), np.concatenate([size, n])
            flat = np.concatenate([*numbers, np.empty(0, np.int64)])
            sizes = size[flat]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.cumsum([0, *map(len, numbers)])
            stops, last, which_of, rare, n_rare, merged_of = [np.zeros(1, np.int64)], [0], [], [], [0], []
            for at, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                gap = np.flatnonzero(sizes[lo:hi] == 0)
                distinct, which = np.unique(numbers[at][gap], return_inverse=True)
                pieces = [every[k] for k in distinct.tolist()]
                long_ = [long_word(p) for p in pieces]
                short = np.array([x is None for x in long_], bool)
                place = np.where(short, np.cumsum(short) - 1, short.sum() + np.cumsum(~short) - 1)
                stops += [ends[lo:hi][gap], ends[hi : hi + 1]]
                last.append(last[-1] + len(gap) + 1)
                which_of.append(np.append(place[which], -1).astype(np.int32))
                rare += [p for p, x in zip(pieces, long_) if x is None]
                n_rare.append(len(rare))
                merged_of.append([x for x in long_ if x is not None])
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate(stops).astype(np.int32)), pa.array(table_.ids[slices(start[flat], sizes)], pa.int32()))
            yield pa.record_batch([
                b.column(0), pa.ListArray.from_arrays(pa.array(last, pa.int32()), parts), pa.array(which_of, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(n_rare, pa.int32()), find(rare)), pa.array(merged_of, pa.list_(pa.list_(pa.int32()))),
            ], names)

    cut = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(look_up, f"doc_id {kind}, parts array<array<int>>, which array<int>, rare array<{WORD}>, merged array<array<int>>")
    # between the parts that were looked up stand the rare pieces, each folded once for the document
    folds = F.concat(bpe(F.col("rare"), rank_map), "merged")
    ids = let(folds, lambda f: F.flatten(F.zip_with("parts", "which", lambda p, k: F.when(k < 0, p).otherwise(F.concat(p, F.get(f, k))))))
    return cut.select("doc_id", ids.alias("ids"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, ids = read_ranks(), F.col("ids")
    found = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(little_endian(ids, ranks), 256).alias("ids_sha256"), F.sha2(decoded(ids, ranks), 256).alias("decoded_sha256")
    )


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
