"""What several operators share: shared storage, graph components, text pieces.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the public vocabularies' splitting pattern counts as white space.
WHITE = r" \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Cuts a text where the splitting pattern must also cut it, whatever stands around:
#: before white space that follows something else, and between Latin letters and
#: ASCII punctuation or digits. Each piece can so be encoded on its own.
PIECE = re.compile(
    rf"[{WHITE}]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{WHITE}!-@\[-`{{-~]|\Z)"
    rf"|[{WHITE}]?[^{WHITE}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a temporary folder stands in on a local master, whose tasks run
    in the driver's process; elsewhere it is an error, as each executor would write to
    its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri and the path there: pyarrow's own, else through Hadoop's client (libhdfs), as Spark does."""
    name, _, rest = uri.partition("://")
    if name in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        host, _, path = rest.partition("/")
        return pafs.HadoopFileSystem(f"{name}://{host}"), f"/{path}"


def write_shared(df: DataFrame, name: str) -> str:
    """Write df once into the shared folder; returns the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back.

    This cuts the lineage; a lost executor costs no recomputation, and all later
    uses see the same rows.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names for new columns: those wanted, with underscores behind where docs has one of that name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


_kept: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a worker keeps under a name for the tasks that follow, until a task comes that does not keep it."""
    return _kept.setdefault(name, {})


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Views of at most so many rows, which bounds the Python objects made at a time.

    Spark itself bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch,
    64 MB unless the user sets it), so no setting of the session has to change. A worker,
    which Spark keeps for the tasks of later stages, first lets go of every worker_cache
    but keep, and at the end of a task gives free memory back.
    """
    for name, held in _kept.items():
        if name != keep:
            held.clear()
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system: Arrow's, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, size: int = 128 << 20, rows: int = 2_000_000) -> int:
    """How many partitions keep the texts of each to about size bytes and rows rows; not fewer than the session has."""
    total, n = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.count("*")).first()
    return max(partitions(docs.sparkSession), -(-(total or 0) // size), -(-n // rows))


def join_keys(rows: DataFrame, table_: DataFrame, keys: Sequence[str], n: str, share: int = 1000) -> DataFrame:
    """Inner join with a (written) table of one row for each key, whose column n counts the key's rows.

    Keys that have more than a ``share``-th of all rows are fewer than ``share``: they are
    broadcast, whatever their size, and their rows stay where they are. Of the others no
    task gets much.
    """
    total = table_.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * share > total
    hot = F.broadcast(table_.where(often))
    rest = rows.join(hot.select(*keys), list(keys), "left_anti").join(table_.where(~often), list(keys))
    return rows.join(hot, list(keys)).unionByName(rest)


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Connected components of the undirected edges: (node, component).

    component is the smallest node of each component. Large-star and small-star steps
    alternate until nothing moves, in about log2(longest path) rounds; each round is
    two aggregations of minima (combined before the shuffle) and joins back, which
    adaptive execution splits where a hub has many neighbours. Every round is written
    to the shared folder. Nodes without an edge do not appear.
    """
    edge = edges.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).where("u <> v").distinct()
    edge = materialize(edge, "edges")
    before = None
    while True:
        state = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edge.select("v", "v").distinct())
        before = state
        both = edge.union(edge.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edge = materialize(small.where("u <> v").distinct(), "edges")


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Each run of rows with equal keys (not null) of a sorted stream, as a table."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows else []
        edges = [0, *cuts, b.num_rows]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            key = tuple(c[start] for c in cols)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def spanning(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a block pair, as row and column indices.

    near[i, j]: row i and column j are linked; same: rows and columns are one block
    (near is symmetric). At most rows + columns - 1 links come back.
    """
    left, right = [], []
    todo_rows = near.any(axis=1)
    todo_cols = todo_rows if same else near.any(axis=0)
    for first in np.flatnonzero(todo_rows):
        if not todo_rows[first]:
            continue
        todo_rows[first] = False
        stack = [(int(first), True)]
        while stack:
            at, is_row = stack.pop()
            rest = todo_cols if is_row else todo_rows
            new = np.flatnonzero((near[at] if is_row else near[:, at]) & rest)
            if len(new):
                rest[new] = False
                left.append(np.full(len(new), at) if is_row else new)
                right.append(new if is_row else np.full(len(new), at))
                stack += [(int(x), same or not is_row) for x in new]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)
