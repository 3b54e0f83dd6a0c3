"""A walk over nested values: path and text of every leaf of a column, whatever its type.

The walk is made from the schema, as one column expression: structs by field, arrays by
place, maps by key, whose keys are leaves too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.rules import EMAIL, PATH, SECRET
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

LEAVES = "array<struct<path:string,value:string>>"


def leaves(value: Column, kind: T.DataType, path: Column | None = None) -> Column:
    """path, value of every leaf: a.b[2].c; a map's value under its key in quotes, and the key itself with # behind. Nulls have none."""
    path = F.lit("") if path is None else path
    none = F.array().cast(LEAVES)
    if isinstance(kind, T.StructType):
        dot = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
        inner = [leaves(value[f.name], f.dataType, F.concat(dot, F.lit(f.name))) for f in kind.fields]
        found = F.concat(*inner) if inner else none
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    elif isinstance(kind, T.MapType):
        def entry(e: Column) -> Column:
            name = F.concat(path, F.lit('["'), e["key"].cast("string"), F.lit('"]'))
            return F.concat(leaves(e["key"], kind.keyType, F.concat(name, F.lit("#"))), leaves(e["value"], kind.valueType, name))

        found = F.flatten(F.transform(F.map_entries(value), entry))
    else:
        found = F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))
    return F.when(value.isNotNull(), found).otherwise(none)


def leaf_violations(df: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """keys, path, code: each leaf of the other columns that a rule's pattern finds."""
    others = [c for c in df.columns if c not in keys]
    packed = T.StructType([df.schema[c] for c in others])
    rows = df.select(*keys, F.explode(leaves(F.struct(*others), packed)).alias("leaf")).select(*keys, "leaf.*")
    broken = F.array_compact(F.array(*(F.when(F.col("value").rlike(p), F.lit(name)) for name, p in rules.items())))
    return rows.select(*keys, "path", F.explode(broken).alias("code"))


RULES = {"path": PATH, "secret": SECRET, "email": EMAIL}


@query("nested_leaks", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, 'body.lines[' || place || '].text' AS path, value FROM l UNION ALL SELECT doc_id, 'about["lang"]', lang FROM documents UNION ALL SELECT doc_id, 'about["from"]', 'dir=/srv/' || source || '/in' FROM documents
      UNION ALL SELECT doc_id, 'about["lang"]#', 'lang' FROM documents UNION ALL SELECT doc_id, 'about["from"]#', 'from' FROM documents)
{" UNION ALL ".join(f"SELECT doc_id, path, '{name}' AS code FROM v WHERE regexp_matches(value, '{p}')" for name, p in RULES.items())}""")
def nested_leaks(t: Tables) -> DataFrame:
    """Documents packed as nested records: the path of every leaf that gives away a path, a secret or an address."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("number"), x.alias("text")))
    about = F.create_map(F.lit("lang"), F.col("lang"), F.lit("from"), F.concat(F.lit("dir=/srv/"), F.col("source"), F.lit("/in")))
    packed = t.read("documents").select("doc_id", F.struct(lines.alias("lines"), F.lit(None).cast("array<string>").alias("notes")).alias("body"), about.alias("about"))
    return leaf_violations(packed, ["doc_id"], RULES)
