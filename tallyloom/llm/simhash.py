"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits over word shingles (XXH64, seed 42). To link fingerprints
that differ in at most ``distance`` bits, each is cut into ``segments`` parts: two such
fingerprints differ in at most distance // segments bits in one part at least. The
Hamming ball of that radius around every part is enumerated and met, by an equality
join, with the parts that occur; complete distances are then verified.

Equal fingerprints are one row throughout, so exact copies cost nothing. Where a part
is shared by many fingerprints (near copies, frequent parts), its rows are split into
blocks and dealt out as pairs of blocks; a task compares a pair of blocks at once and
returns a spanning forest of what it links, never all pairs. Every link is compared;
none is dropped.

Defined results: null and empty texts, and texts of ASCII white space, have fingerprint
zero and are linked like any other; repeated rows appear as often as they stand in the
input, in the same component; null doc_id rows take part, with the null left out of
the minimum; columns besides doc_id and text are ignored; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import components, materialize, runs, sliced, spanning, table

SHINGLE, DISTANCE, SEGMENTS, BLOCK = 3, 3, 2, 2048
WORDS = 65536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, WORDS):  # long texts in parts
        part = words[at : at + WORDS + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        h = np.array([digest(x, 42) for x in joined], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, 1000):
            yield pa.record_batch([b.column(0), pa.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def link_tiles(batches, distance: int):
    """Arrow batches sorted by (part, key, i, j): the links of each tile's spanning forest.

    side 0 holds the rows of block i, side 1 those of block j (none where i = j). One
    side of a pair at least must be a member of the part, the other one may come from
    the ball around it.
    """
    for rows in runs(batches, ["part", "key", "i", "j"]):
        fp, side, member = (rows.column(c).to_numpy() for c in ("fp", "side", "member"))
        a, ma = fp[side == 0].view(np.uint64), member[side == 0]
        same = len(a) == len(fp)
        b, mb = (a, ma) if same else (fp[side == 1].view(np.uint64), member[side == 1])
        if len(a) == 0 or len(fp) < 2:
            continue
        near = ma[:, None] | mb[None, :]
        for lo in range(0, len(a), 256):
            near[lo : lo + 256] &= np.bitwise_count(a[lo : lo + 256, None] ^ b[None, :]) <= distance
        if same:
            np.fill_diagonal(near, False)
        i, j = spanning(near, same)
        if len(i):
            yield pa.record_batch([pa.array(a[i].view(np.int64)), pa.array(b[j].view(np.int64))], ["a", "b"])


def near_links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links a, b that connect all fingerprints (column fp, distinct) with at most distance differing bits."""
    width, radius = 64 // segments, distance // segments
    low = [width * s for s in range(segments)]
    size = [width] * (segments - 1) + [64 - width * (segments - 1)]
    cut = [F.shiftrightunsigned("fp", low[s]).bitwiseAND(F.lit((1 << size[s]) - 1 if size[s] < 64 else -1)) for s in range(segments)]
    own = fps.select("fp", F.posexplode(F.array(*cut)).alias("part", "key"))
    balls = [[sum(1 << k for k in c) for r in range(1, radius + 1) for c in combinations(range(size[s]), r)] for s in range(segments)]
    masks = F.array(*(F.array(*(F.lit(m).cast("bigint") for m in ball)) if ball else F.array().cast("array<bigint>") for ball in balls))
    probe = own.select("fp", "part", F.explode(F.transform(F.element_at(masks, F.col("part") + 1), lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    # a part is worth a look where it has a member and anything else
    there = own.groupBy("part", "key").agg(F.count("*").alias("members"))
    met = probe.join(there.select("part", "key"), ["part", "key"], "left_semi").select("fp", "part", "key", F.lit(False).alias("member"))
    crowded = own.join(there.where("members > 1"), ["part", "key"], "left_semi").select("fp", "part", "key", F.lit(True).alias("member"))
    lone = own.join(met.select("part", "key").distinct(), ["part", "key"], "left_semi").select("fp", "part", "key", F.lit(True).alias("member"))
    rows = materialize(met.union(crowded.union(lone).distinct()), "parts")
    count = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(f"n > {block}").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = rows.join(count.select("part", "key", "blocks"), ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.select("part", "key", "fp", "member", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "member")
    keys = ["part", "key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: link_tiles(it, distance), "a bigint, b bigint")


def near_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row; linked rows, directly or through others, share the smallest doc_id."""
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "fps")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(near_links(fps.select("fp"), distance, segments))
    with_group = fps.join(groups, fps.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    with_group = materialize(with_group, "groups")
    least = with_group.groupBy("group").agg(F.min("first").alias("component_id"))
    by_fp = with_group.join(least, "group").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLES = {}
