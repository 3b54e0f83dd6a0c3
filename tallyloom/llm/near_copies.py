"""Near copies by SimHash, and by true Jaccard similarity from 0.8, on five-word shingles.

A text is the set of the XXH64 hashes of its five-word shingles; a shorter text is one
shingle. Equal sets are one row throughout. Two searches make links:

* the multi-index SimHash search of simhash.py over the majority bits of each set: at most
  3 of 64 bits differ. That radius reaches few pairs of similarity 0.8, where about ten
  bits differ, and balls of that size cannot be enumerated; so, besides,
* texts meet in the buckets of a banded MinHash: 20 bands of 5 minima, so that a pair of
  similarity 0.8 shares a bucket with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996, and
  unrelated texts hardly ever do. No link is made there without comparing the whole sets:
  first each text with one member of each of its buckets, another order in each band; then,
  in the buckets whose members are not yet one component, everyone outside the component
  of that member with everyone, in pairs of blocks of bounded size.

Pairs in one component already need no comparison, so a large group of copies costs
about one comparison for each text and bucket; a leader's text is dealt out again for
every 200 texts that are compared with it, so that no task gets all of them.

Defined results: null and empty texts have no shingles and are copies of each other;
repeated rows appear as often as they stand in the input; null doc_id rows take part,
with the null left out of the minimum; very long texts are compared whole; extra columns
are carried by kept(), whatever their names; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import components, materialize, runs, sliced
from tallyloom.llm.simhash import near_links

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 20, 5, 128
LED = 200  # texts that are compared with one copy of their leader
_rng = np.random.default_rng(8)
_FLIP, _ODD = (_rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64))


def bucket_keys(s: np.ndarray) -> list[int]:
    """One key for each band; none for an empty set."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):  # long texts in parts
        least = np.minimum(least, ((s[None, at : at + 4096] ^ _FLIP[:, None]) * _ODD[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in least.reshape(BANDS, ROWS)]


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is at least similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def majority(s: np.ndarray) -> int:
    """SimHash of a set as a signed integer: the bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 65536):  # long texts in parts
        ones += np.unpackbits(s[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def signatures(docs: DataFrame) -> DataFrame:
    """row (all columns), fp (of the set of shingles), sim (its SimHash), keys."""
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in sliced(batches, 1000):
            sets = [shingles(x) for x in b.column("text").to_pylist()]
            fp = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            keys = pa.array([bucket_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([b.column("row"), pa.array(fp, pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), keys], ["row", "fp", "sim", "keys"])

    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def verified(batches, similarity: float):
    """Of the pairs a, a_text, b, b_text (many rows in a row share b), those that are alike."""
    held, other = None, None
    for rows in batches:
        out = []
        for a, a_text, b, b_text in zip(*(rows.column(c).to_pylist() for c in ("a", "a_text", "b", "b_text"))):
            if b != held:
                held, other = b, shingles(b_text)
            if alike(shingles(a_text), other, similarity):
                out.append((a, b))
        yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def link_blocks(batches, similarity: float):
    """Batches sorted by (band, key, i, j): links between members of side 0 and side 1 of each tile that join components."""
    for rows in runs(batches, ["band", "key", "i", "j"]):
        fp, group, side, text = (rows.column(c).to_pylist() for c in ("fp", "group", "side", "text"))
        root = {g: g for g in group}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        sets = [shingles(t) for t in text]
        out = []
        for p in (k for k in range(len(fp)) if side[k] == 0):
            for q in (k for k in range(len(fp)) if side[k] == 1):
                if find(group[p]) != find(group[q]) and alike(sets[p], sets[q], similarity):
                    root[find(group[p])] = find(group[q])
                    out.append((fp[p], fp[q]))
        if out:
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def simhash_links(marked: DataFrame) -> DataFrame:
    """Links a, b of fp that connect all texts whose SimHashes differ in at most 3 bits."""
    one = marked.select("fp", "sim").distinct()
    first = materialize(one.groupBy("sim").agg(F.min("fp").alias("first")), "sims")
    same = one.join(first, "sim").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = near_links(first.select(F.col("sim").alias("fp")))
    near = near.join(first.select(F.col("sim").alias("a"), F.col("first").alias("a_first")), "a").join(first.select(F.col("sim").alias("b"), F.col("first").alias("b_first")), "b")
    return same.union(near.select("a_first", "b_first"))


def groups_of(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All rows (rid, row, fp), and for each fp the first row of its group: fp, least (doc_id, rid; nulls last)."""
    marked = materialize(signatures(docs).withColumn("rid", F.monotonically_increasing_id()), "marked")
    member = marked.select("fp", F.posexplode("keys").alias("band", "key"))
    turn = F.xxhash64("band")  # another order of fingerprints in each band
    ends = member.groupBy("band", "key").agg(F.min(F.col("fp").bitwiseXOR(turn)).alias("least"), F.max(F.col("fp").bitwiseXOR(turn)).alias("most"))
    shared = ends.where("least <> most").select("band", "key", F.col("least").bitwiseXOR(turn).alias("leader"))
    crowded = materialize(member.join(shared, ["band", "key"]).select("band", "key", "fp", "leader").distinct(), "crowded")
    texts = marked.select("fp", F.col("row.text").cast("string").alias("text")).join(crowded.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])
    texts = materialize(texts, "texts")

    # a leader of many is dealt out with its text to several tasks, each of which gets about LED of them
    pairs = materialize(crowded.where("fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    parts = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts")), "leaders")
    leaders = parts.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("b_text")), "b").select("b", "b_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    many = parts.where("parts > 1")  # at most a LED-th of the pairs
    pairs = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    pairs = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("a_text")), "a").join(leaders, ["b", "part"])
    links = materialize(pairs.mapInArrow(lambda it: verified(it, similarity), "a bigint, b bigint").union(simhash_links(marked)), "links")

    group = materialize(components(links), "groups")
    rows = crowded.join(group.select(F.col("node").alias("fp"), F.col("component").alias("fp_group")), "fp", "left")
    rows = rows.join(group.select(F.col("node").alias("leader"), F.col("component").alias("leader_group")), "leader", "left")
    rows = rows.select("band", "key", "fp", F.coalesce("fp_group", "fp").alias("group"), F.coalesce("leader_group", "leader").alias("main"))
    rows = materialize(rows, "rows")
    size = rows.groupBy("band", "key").agg(F.count_if(F.col("group") != F.col("main")).alias("apart"), F.count("*").alias("n")).where("apart > 0")
    size = size.select("band", "key", F.ceil(F.col("apart") / block).cast("int").alias("across"), F.ceil(F.col("n") / block).cast("int").alias("down"))
    rows = rows.join(size, ["band", "key"])
    own = lambda n: F.pmod(F.xxhash64("fp", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    apart = rows.where(F.col("group") != F.col("main")).select("band", "key", "fp", "group", F.lit(0).alias("side"), own("across").alias("i"), each("down").alias("j"))
    everyone = rows.select("band", "key", "fp", "group", F.lit(1).alias("side"), each("across").alias("i"), own("down").alias("j"))
    keys = ["band", "key", "i", "j"]
    tiles = apart.union(everyone).join(texts, "fp").repartition(*keys).sortWithinPartitions(*keys)
    more = materialize(tiles.mapInArrow(lambda it: link_blocks(it, similarity), "a bigint, b bigint"), "more")

    # the second round connects the components of the first one
    joined = more.join(group.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a", "left").join(group.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b", "left")
    again = components(joined.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
    fps = marked.groupBy("fp").agg(F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "rid")).alias("first"))
    fps = fps.join(group, fps.fp == group.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    fps = fps.join(again, fps.group == again.node, "left").select("fp", "first", F.coalesce("component", "group").alias("group"))
    fps = materialize(fps, "groups")
    least = fps.groupBy("group").agg(F.min("first").alias("least"))
    return marked.drop("keys", "sim"), fps.join(least, "group").select("fp", "least")


def near_components(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id of every row; linked rows, directly or through others, share the smallest doc_id."""
    marked, groups = groups_of(docs, similarity, block)
    return marked.select("row.doc_id", "fp").join(groups, "fp").select("doc_id", F.col("least.doc_id").alias("component_id"))


def kept(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row of each group: that with the smallest doc_id, and of several such rows one."""
    marked, groups = groups_of(docs, similarity, block)
    return marked.join(groups.select(F.col("least.rid").alias("rid")).distinct(), "rid", "left_semi").select("row.*")
