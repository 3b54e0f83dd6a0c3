"""Bounded-space online packing of documents into sequences.

Each partition encodes its documents in the order of its input and keeps a fixed number
of open windows. A document longer than a window is cut into whole windows and a rest.
A rest goes to the open window that it leaves the fullest (best fit); where none has
room, a new window is opened, and if as many as allowed are open, the fullest is first
emitted. What stays open at the end is bounded for each partition; in groups of
``merge`` partitions the pieces of these windows are packed again, longest first.

Defined results: null and empty texts are the end id alone; repeated rows are packed
each; a null doc_id is carried along; ids are of an integer type; very long texts fill
several windows; of equally good windows the first is taken; extra columns are ignored; an
empty table gives none. Every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, sliced, table
from tallyloom.llm.encoding import CACHE, encoder, read_vocabulary

LENGTH, WINDOWS, MERGE, END_ID = 2048, 64, 64, 1
PIECE_COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Windows:
    """Open windows of a fixed length; place() tells which windows it had to emit."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.next = length, most, 0
        self.room: list[tuple[int, int]] = []  # (free places, window), sorted
        self.rows: dict[int, list] = {}

    def place(self, size: int, row) -> list[tuple[int, list]]:
        out = []
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                out.append(self._emit(0))
            free, window = self.length, self.next
            self.next += 1
            self.rows[window] = []
        self.rows[window].append((*row, self.length - free))
        if free > size:
            insort(self.room, (free - size, window))
        else:
            out.append((window, self.rows.pop(window)))
        return out

    def _emit(self, at: int):
        window = self.room.pop(at)[1]
        return window, self.rows.pop(window)

    def rest(self) -> list[tuple[int, list]]:
        return [self._emit(0) for _ in range(len(self.room))]


def pack(docs: DataFrame, vocabulary: bytes, end_id: int = END_ID, length: int = LENGTH, windows: int = WINDOWS, merge: int = MERGE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary)

    def rows_of(done, part, whole):
        for window, rows in done:
            for r in rows:
                yield (*r[:-1], part, window, r[-1], whole)

    def run(batches):
        part, code, open_ = TaskContext.get().partitionId(), encoder(vocab.value), Windows(length, windows)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "whole"]

        def batch(rows):
            return pa.record_batch([pa.array(c, pa.int64() if n != "whole" else pa.bool_()) for n, c in zip(names, zip(*rows))], names)

        for b in sliced(batches, keep=CACHE):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), code.encode(b.column(1).to_pylist())):
                ids = np.append(ids, code.dtype.type(end_id)).astype("<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows += rows_of(open_.place(len(piece), (doc_id, at, len(piece), zlib.crc32(piece), len(ids))), part, True)
            if rows:
                yield batch(rows)
        if rows := list(rows_of(open_.rest(), part, False)):
            yield batch(rows)

    pieces = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECE_COLUMNS + ", part bigint, window bigint, offset bigint, whole boolean")
    pieces = materialize(pieces, "pieces")

    def again(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        w, group = Windows(length, t.num_rows + 1), t.column("group")[0].as_py()
        done = []
        for k, size in enumerate(t.column("length").to_pylist()):
            done += w.place(size, (k,))
        place = {k: (window, offset) for window, rows in done + w.rest() for k, offset in rows}
        window, offset = (pa.array([place[k][c] for k in range(t.num_rows)], pa.int64()) for c in (0, 1))
        out = t.select([c.split()[0] for c in PIECE_COLUMNS.split(", ")])
        return out.append_column("sequence_id", pa.array(np.asarray(window) + ((2 * group + 1) << 32))).append_column("offset", offset)

    columns = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]
    emitted = pieces.where("whole").select(*columns, F.expr("shiftleft(2 * part, 32) + window").alias("sequence_id"), "offset")
    left = pieces.where("not whole").withColumn("group", F.floor(F.col("part") / merge).cast("bigint"))
    merged = left.groupBy("group").applyInArrow(again, PIECE_COLUMNS + ", sequence_id bigint, offset bigint")
    return emitted.union(merged)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), read_vocabulary())


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
