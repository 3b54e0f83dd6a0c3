"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by range of doc_id and sorted; each partition encodes its own
and writes one Arrow IPC file whose record batches hold two fixed-size lists, ``ids``
(16 bits where the vocabulary allows) and ``mask`` (false on the padding of a file's
last sequence). Sequence k of a file is row k % BATCH of batch k // BATCH: mapped into
memory, any sequence and its mask (packed bits, as Arrow has them) is read without a copy.
Ranges are sized by bytes and rows. A second small file has each document's
place, written as it comes. A file appears under its name only when complete, and a task that runs again
writes the same bytes; a manifest lists the files.

Defined results: null and empty texts have the end id alone; rows with one doc_id follow
each other in order of text; a null doc_id comes first; ids are of an
integer type; very long texts are encoded whole, in their place; extra columns are ignored; an
empty table gives files without sequences and no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import file_system, materialize, parts_for, partitions, shared_dir, sliced, table
from tallyloom.llm.encoding import CACHE, encoder, read_vocabulary

LENGTH, BATCH, END_ID = 2048, 256, 0


class TokenFile:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids of batch k, one row for each sequence, and the mask of all its ids one after the other; both are views."""
        b = self.reader.get_batch(k)
        return b.column(0).flatten().to_numpy().reshape(-1, self.length), b.column(1).flatten()

    def sequence(self, k: int) -> np.ndarray:
        """The ids of sequence k, a view."""
        return self.reader.get_batch(k // BATCH).column(0)[k % BATCH].values.to_numpy()

    def mask(self, k: int) -> np.ndarray:
        """The mask of sequence k as packed bits, lowest first (numpy.unpackbits, bitorder="little"), a view."""
        bits = self.reader.get_batch(k // BATCH).column(1).values
        start = (bits.offset + k % BATCH * self.length) // 8
        return np.frombuffer(bits.buffers()[1], np.uint8)[start : start + self.length // 8]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of the file's unpadded stream."""
        step = self.length * BATCH
        parts = [self.reader.get_batch(k).column(0).flatten().to_numpy()[max(0, start - k * step) : stop - k * step] for k in range(start // step, (stop + step - 1) // step)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint16)])


class _Writer:
    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.length * BATCH:
            flat, step = np.concatenate(self.held), self.length * BATCH
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._write(flat[at : at + step], step)
            self.held, self.count = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(len(flat)) < real)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()


def write_tokens(docs: DataFrame, folder: str, vocabulary: bytes, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Write doc_id, text in ascending doc_id order; the manifest: shard, file, n_docs, n_tokens."""
    spark = docs.sparkSession
    kind = pa.int64()
    vocab = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        shard, code = TaskContext.get().partitionId(), encoder(vocab.value)
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}.arrow"
        mine = f"{name}.{uuid.uuid4().hex}"
        n_docs, kinds = 0, pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        with fs.open_output_stream(mine) as sink, fs.open_output_stream(f"{mine}.docs") as places, pa.ipc.new_file(places, kinds) as out:
            w = _Writer(sink, code.dtype, length)
            for b in sliced(batches, keep=CACHE):
                start, sizes = w.total, []
                for ids in code.encode(b.column(1).to_pylist()):
                    w.add(np.append(ids, code.dtype.type(end_id)))
                    sizes.append(len(ids) + 1)
                n_docs += len(sizes)
                out.write_batch(pa.record_batch([b.column(0), pa.array(start + np.cumsum([0, *sizes])[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=kinds))
            w.close()
        fs.move(mine, name)
        fs.move(f"{mine}.docs", f"{name}.docs")
        yield pa.record_batch([[shard], [f"{folder}/shard-{shard:06d}.arrow"], [n_docs], [w.total]], ["shard", "file", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(run, "shard bigint, file string, n_docs bigint, n_tokens bigint"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in sliced(batches, keep=CACHE):
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                f, (fs, path) = TokenFile(file), file_system(f"{file}.docs")
                with fs.open_input_file(path) as source, pa.ipc.open_file(source) as places:
                    for part in map(places.get_batch, range(places.num_record_batches)):
                        start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(f.tokens(s, s + k).astype("<u4")) for s, k in zip(start.tolist(), n.tolist())]
                        yield pa.record_batch([part.column("doc_id"), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(partitions(spark), "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder, read_vocabulary()))


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
