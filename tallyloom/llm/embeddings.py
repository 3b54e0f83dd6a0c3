"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are turned into the principal axes of all vectors of their length, widest first,
which leaves cosines as they are. Pairs of blocks are compared at once: leading axes first, the
rest bounded by the product of the suffix norms (Cauchy-Schwarz); a pair is left as
soon as it can't reach the threshold. What remains is decided on the given components
in double precision.

Blocks: the angle to the first axis is binned; two vectors whose angles differ by more
than arccos(threshold) can't be linked, so only bins near each other meet. A bin is
split by hash into blocks of about ``block`` rows, and a task compares two blocks. It
returns the number of links of each row and a spanning forest, never all pairs.
Equal vectors of a label are one row throughout.

Defined results: null or empty vectors, zero vectors, those with null or non-finite
components and those without a label link with nothing; vectors of different lengths
aren't compared; repeated rows count as further vectors, each returned; extra columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import components, join_keys, materialize, runs, sliced, spanning, table

THRESHOLD, BLOCK, STEPS, BINS = 0.93, 2048, (8, 16, 32), 4
SPLIT, BYTES = 8, 32 << 20  # blocks that a large bin has at least, bytes that a block has at most
SLACK = 1e-9  # more than rounding can shift a bound


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """rid, label, embedding, dim, copies, least: one row for each label and usable vector."""
    x = F.col("embedding")
    usable = F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    groups = vectors.where(usable).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return materialize(groups.withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    n = len(column)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def axes(groups: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the principal axes (columns, widest first) of all unit vectors.

    Partitions send one sum of outer products each, added up before they meet; the
    driver gets length * length numbers.
    """

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in sliced(batches, 2048):
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                x = matrix(b.column("embedding").filter(pa.array(dims == d)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total[int(d)] = total.get(int(d), 0) + x.T @ x
        for d, m in total.items():
            yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "row", "sums"])

    parts = groups.select("dim", "embedding").mapInArrow(sums, "dim int, row int, sums array<double>")
    cells = parts.select("dim", "row", F.posexplode("sums").alias("col", "x")).groupBy("dim", "row", "col").agg(F.sum("x").alias("x")).collect()
    found: dict[int, np.ndarray] = {}
    for c in cells:
        found.setdefault(c["dim"], np.zeros((c["dim"], c["dim"])))[c["row"], c["col"]] = c["x"]
    return {d: np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]) for d, m in found.items()}


class Turned:
    """Vectors on the principal axes, as unit vectors, with the norms of their suffixes."""

    def __init__(self, x: np.ndarray, axes_: np.ndarray):
        self.x, self.norm = x, np.linalg.norm(x, axis=1)
        self.p = x / self.norm[:, None] @ axes_
        tail = np.sqrt(np.maximum(np.cumsum((self.p * self.p)[:, ::-1], axis=1)[:, ::-1], 0))
        self.tail = np.hstack([tail, np.zeros((len(x), 1))])

    def part(self, at: slice) -> Turned:
        out = object.__new__(Turned)
        out.x, out.norm, out.p, out.tail = self.x[at], self.norm[at], self.p[at], self.tail[at]
        return out


def near_pairs(x: Turned, y: Turned, threshold: float, same: bool, steps=STEPS) -> np.ndarray:
    """near[i, j]: cosine of x[i] and y[j] is at least threshold."""
    a, ta, b, tb = x.p, x.tail, y.p, y.tail
    d, near, at = a.shape[1], np.zeros((len(a), len(b)), bool), 0
    dots = np.zeros((len(a), len(b)))
    rows = cols = None  # the pairs left, once they are few
    for step in [s for s in steps if s < d] + [d]:
        if rows is None:
            dots += a[:, at:step] @ b[:, at:step].T
            live = dots + ta[:, step, None] * tb[None, :, step] >= threshold - SLACK
            if same:
                live &= np.triu(np.ones_like(live), 1)
            if step == d or live.mean() < 0.02:
                rows, cols = np.nonzero(live)
                left = dots[rows, cols]
        else:
            left = left + np.einsum("ij,ij->i", a[rows, at:step], b[cols, at:step])
            live = left + ta[rows, step] * tb[cols, step] >= threshold - SLACK
            rows, cols, left = rows[live], cols[live], left[live]
        at = step
    for lo in range(0, len(rows), 65536):
        i, j = rows[lo : lo + 65536], cols[lo : lo + 65536]
        near[i, j] = np.einsum("ij,ij->i", x.x[i], y.x[j]) / (x.norm[i] * y.norm[j]) >= threshold
    return near | near.T if same else near


def tiles(groups: DataFrame, axes_: dict[int, np.ndarray], threshold: float, block: int, bins: int, size: int) -> DataFrame:
    """Rows dealt out as block pairs: label, dim, i, j name the pair; side 0 is block i, side 1 block j."""
    width = (np.arccos(threshold) + 1e-7) / bins

    def binned(batches):
        for b in sliced(batches, 2048):
            dims, out = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims):
                at = dims == d
                x = matrix(b.column("embedding").filter(pa.array(at)))
                out[at] = np.arccos(np.clip(x @ axes_[int(d)][:, 0] / np.linalg.norm(x, axis=1), -1, 1)) // width
            yield pa.record_batch([*b.columns, pa.array(out)], [*b.schema.names, "bin"])

    kind = groups.schema["label"].dataType.simpleString()
    item = groups.schema["embedding"].dataType.simpleString()
    rows = groups.select("label", "dim", "rid", "copies", "embedding").mapInArrow(binned, f"label {kind}, dim int, rid bigint, copies bigint, embedding {item}, bin int")
    rows = materialize(rows, "bins")
    cell = ["label", "dim", "bin"]
    most = F.greatest(F.lit(block), F.least(F.col("n") / SPLIT, F.lit(size) / (8 * F.col("dim"))))
    blocks = materialize(rows.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / most).cast("int")), "blocks")
    # for each bin, the blocks of the bins within reach
    reach = blocks.select("label", "dim", "bin", F.explode(F.sequence(F.lit(-bins), F.lit(bins))).alias("step"))
    reach = reach.withColumn("to", F.col("bin") + F.col("step"))
    to = blocks.select("label", "dim", F.col("bin").alias("to"), "blocks")
    reach = reach.join(to, ["label", "dim", "to"]).groupBy(*cell).agg(F.collect_list(F.struct("to", "blocks")).alias("reach"))  # at most 2 * bins + 1
    own = materialize(blocks.join(reach, cell), "reach")
    dealt = join_keys(rows, own, cell, "n").withColumn("own", F.struct("bin", F.pmod(F.xxhash64("rid"), "blocks").cast("int").alias("block")))
    other = F.flatten(F.transform("reach", lambda r: F.transform(F.sequence(F.lit(0), r["blocks"] - 1), lambda k: F.struct(r["to"].alias("bin"), k.alias("block")))))
    dealt = dealt.select("label", "dim", "rid", "copies", "embedding", "own", F.explode(other).alias("other"))
    return dealt.select(
        "label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "rid", "copies", "embedding",
    ).select("label", "dim", "i.*", F.col("j.bin").alias("bin2"), F.col("j.block").alias("block2"), "side", "rid", "copies", "embedding")


def compare(batches, axes_: dict[int, np.ndarray], threshold: float, block: int):
    """For each tile: rid and its links (b null), and forest links a, b (n null)."""
    for t in runs(batches, ["label", "dim", "bin", "block", "bin2", "block2"]):
        side, rid, copies = (t.column(c).to_numpy() for c in ("side", "rid", "copies"))
        x, turn = matrix(t.column("embedding")), axes_[t.column("dim")[0].as_py()]
        same = t.column("bin")[0] == t.column("bin2")[0] and t.column("block")[0] == t.column("block2")[0]
        at, to = side == 0, side == 0 if same else side == 1
        if not at.any() or not to.any():
            continue
        left = Turned(x[at], turn)
        right = left if same else Turned(x[to], turn)
        del x
        rows, cols, a_rid, b_rid = copies[at], copies[to], rid[at], rid[to]
        n_left, n_right = np.zeros(len(rows), np.int64), np.zeros(len(cols), np.int64)
        for i in range(0, len(rows), block):
            for j in range(i if same else 0, len(cols), block):
                own = same and i == j
                a, b = slice(i, i + block), slice(j, j + block)
                near = near_pairs(left.part(a), right.part(b), threshold, own)
                if not near.any():
                    continue
                n_left[a] += near @ cols[b]
                if not own:
                    n_right[b] += near.T @ rows[a]
                p, q = spanning(near, own)
                yield pa.record_batch([pa.array(a_rid[a][p]), pa.array(b_rid[b][q]), pa.nulls(len(p), pa.int64())], ["a", "b", "n"])
        for ids, n in ((a_rid, n_left), (b_rid, n_right)):
            yield pa.record_batch([pa.array(ids[n > 0]), pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0])], ["a", "b", "n"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, bins: int = BINS, size: int = BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    groups = distinct_vectors(vectors)
    turn = axes(groups)
    keys = ["label", "dim", "bin", "block", "bin2", "block2"]
    found = tiles(groups, turn, threshold, block, bins, size).repartition(*keys).sortWithinPartitions(*keys)
    found = materialize(found.mapInArrow(lambda it: compare(it, turn, threshold, block), "a bigint, b bigint, n bigint"), "links")
    links = found.where("n is not null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("links"))
    comps = components(found.where("b is not null"))
    info = groups.join(links, "rid", "left").join(comps, groups.rid == comps.node, "left").select(
        "label", "embedding", F.coalesce("component", "rid").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    info = materialize(info, "linked")
    least = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = info.join(least, "root").select("label", "embedding", "n_links", "component_id")
    return vectors.select("vec_id", "label", "embedding").join(info, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {THRESHOLD}),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON vec_id = id LEFT JOIN n ON vec_id = a"""

QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLES = {"op6_embedding_dedup": ORACLE}
