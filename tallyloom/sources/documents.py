"""JSON documents as a Spark data source: format "checked_json".

Reads the documents of a string column of parquet files (option column, with key as a
column to carry along), or whole text files. Each is parsed with its keys checked, since
JSON readers keep one of repeated keys silently. A row has key, doc (the document in
canonical spelling: sorted keys, no blanks) and problem; of these one of doc and problem
is null. With option mode "failfast" the first bad document ends the read; "partial", the
default, makes it a row.

    spark.dataSource.register(CheckedJson)
    spark.read.format("checked_json").option("column", "props").option("key", "event_id").load("…/events.parquet")

A partition is a row group of a parquet file, or a file. Null texts are no documents and
have no row. Paths are opened on the executors by pyarrow: local or shared folders, S3,
and what Hadoop's client library reaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, doc string, problem string"
NAMES = ("key", "doc", "problem")


class RepeatedKey(ValueError):
    """A key stands twice in one object."""


def distinct_keys(pairs: list[tuple[str, object]]) -> dict:
    found: dict = {}
    for key, value in pairs:
        if key in found:
            raise RepeatedKey(f"repeated key: {key}")
        found[key] = value
    return found


def not_a_number(name: str) -> None:
    raise ValueError(f"not a number: {name}")


def canonical(text: str) -> tuple[str | None, str | None]:
    """(document, None) or (None, problem)."""
    try:
        value = json.loads(text, object_pairs_hook=distinct_keys, parse_constant=not_a_number)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None
    except (ValueError, RecursionError) as e:
        return None, (str(e) or type(e).__name__)[:200]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    name, _, rest = path.partition(":")
    if name == "file" and not rest.startswith("//"):  # file:/x, as Spark prints it
        path = f"file://{rest}"
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


class Part(InputPartition):
    """A file, or a row group of one."""

    def __init__(self, file: str, group: int):
        super().__init__((file, group))
        self.file, self.group = file, group


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.column, self.key, self.mode = options["path"], options.get("column"), options.get("key"), options.get("mode", "partial").lower()
        if self.mode not in ("partial", "failfast"):
            raise ValueError(f"mode is partial or failfast, not {self.mode}")

    def partitions(self) -> list[Part]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        files = sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        if not files:
            raise FileNotFoundError(self.path)
        if not self.column:
            return [Part(f, 0) for f in files]
        return [Part(f, g) for f in files for g in range(pq.ParquetFile(f, filesystem=fs).num_row_groups)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        if not self.column:
            with fs.open_input_file(partition.file) as f:
                text = f.read().decode("utf-8", "replace")
            yield self.checked([partition.file], [text])
            return
        with pq.ParquetFile(partition.file, filesystem=fs) as file:
            wanted = [self.column, *([self.key] if self.key else [])]
            for b in file.iter_batches(2000, [partition.group], columns=wanted):
                keys = b.column(b.schema.get_field_index(self.key)).to_pylist() if self.key else [None] * b.num_rows
                yield self.checked(keys, b.column(b.schema.get_field_index(self.column)).to_pylist())

    def checked(self, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        rows = []
        for key, text in zip(keys, texts):
            if text is None:
                continue
            doc, problem = canonical(text)
            if problem and self.mode == "failfast":
                raise ValueError(f"document {key}: {problem}")
            rows.append((None if key is None else str(key), doc, problem))
        return pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], NAMES)


class CheckedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checked_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
