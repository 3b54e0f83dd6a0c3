"""Files beside the tables: checked JSON documents, digests, exports, publishing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _repeats(pairs: list) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError(f"repeated key: {next(k for k in keys if keys.count(k) > 1)}")
    return dict(pairs)


@F.pandas_udf(T.StringType())
def json_problem(text: pd.Series) -> pd.Series:
    """Why a text is no JSON document with unique keys; null if it is one."""

    def problem(t):
        try:
            json.loads(t, object_pairs_hook=_repeats)
        except (TypeError, ValueError) as e:
            return str(e)[:200]
        return None

    return text.map(problem)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, doc (of the given schema), problem: one row for each JSON file; a bad file is a row, not a failure."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.from_json("value", schema).alias("doc"), json_problem("value").alias("problem"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export(df: DataFrame, path: str, *by: str) -> None:
    """JSON files in one folder for each value of by; a reader of some values opens only theirs.

    The folder is a new version, to which readers (exported) are pointed once it is whole.
    """
    _export(df.repartition(*by), path, by)


def _export(df: DataFrame, path: str, by: Sequence[str]) -> None:
    version = f"{path}/export/version-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).json(version)
    _point(df.sparkSession, path, {"export": version})


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The export that holds."""
    return spark.read.json(_manifests(spark, path, 1)[0]["export"])


def publish(df: DataFrame, path: str, valid: Callable[[DataFrame], bool]) -> DataFrame:
    """Write a new version folder, check what can be read back, then point to it.

    Versions are never changed, and the pointer is one small file that is replaced when a
    version is whole, so readers see the old or the new one; a version that isn't valid
    stays for inspection and is not pointed to.
    """
    spark = df.sparkSession
    version = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    back = spark.read.schema(df.schema).parquet(version)
    if not valid(back):
        raise ValueError(f"not published; see {version}")
    now = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    now.coalesce(1).write.mode("append").json(f"{path}/published")
    return back


def published(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The version that holds; back: 1 for the one before it (a rollback reads that)."""
    versions = spark.read.schema("version string, at timestamp").json(f"{path}/published").orderBy(F.desc("at")).limit(back + 1).collect()
    return spark.read.parquet(versions[back]["version"])


def pinned(spark: SparkSession, path: str, schema: str, digest: str) -> DataFrame:
    """A JSON inventory whose canonical form (sorted keys) must have the given SHA-256."""
    doc = spark.read.text(path, wholetext=True)

    @F.pandas_udf(T.StringType())
    def canonical(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(json.loads(t, object_pairs_hook=_repeats), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    rows = doc.select(F.from_json("value", schema).alias("doc"), F.sha2(canonical("value"), 256).alias("digest"))
    wrong = F.raise_error(F.concat(F.lit("inventory has digest "), "digest"))
    return rows.select(F.when(F.col("digest") == digest, F.col("doc")).otherwise(wrong.cast(rows.schema["doc"].dataType)).alias("doc"))


def export_ordered(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """One JSON document for each value of by, its records in order: file-per-key exports that come out the same each time."""
    record = F.struct(*order, *(c for c in df.columns if c not in by and c not in order))
    docs = df.groupBy(*by).agg(F.sort_array(F.collect_list(record)).alias("records"))
    _export(docs.repartition(*by).sortWithinPartitions(*by), path, by)


def publish_together(tables: dict[str, DataFrame], path: str, valid: Callable[[dict[str, DataFrame]], bool]) -> dict[str, DataFrame]:
    """Write a new version folder for each table, check all that can be read back, then point to all of them at once.

    The manifest is one line that names every folder; until it is written readers see the
    versions before, all of them, and after it the new ones, whatever fails between two
    writes. Nothing is changed in place.
    """
    spark = next(iter(tables.values())).sparkSession
    folders = {name: f"{path}/{name}/version-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(folders[name])
    back = {name: spark.read.schema(df.schema).parquet(folders[name]) for name, df in tables.items()}
    if not valid(back):
        raise ValueError(f"not published; see {', '.join(folders.values())}")
    _point(spark, path, folders)
    return back


def _point(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    entry = spark.createDataFrame([(folders,)], "versions map<string,string>").withColumn("at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").json(f"{path}/together")


def _manifests(spark: SparkSession, path: str, n: int) -> list[dict[str, str]]:
    rows = spark.read.schema("versions map<string,string>, at timestamp").json(f"{path}/together").orderBy(F.desc("at")).limit(n).collect()
    return [r["versions"] for r in rows]


def published_together(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that hold now, of one and the same manifest."""
    return {name: spark.read.parquet(folder) for name, folder in _manifests(spark, path, 1)[0].items()}


def roll_back_together(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Point to the manifest before the present one again, by a new entry; all tables go back at once."""
    found = _manifests(spark, path, 2)
    if len(found) < 2:
        raise ValueError("there is no version before")
    _point(spark, path, found[1])
    return published_together(spark, path)
