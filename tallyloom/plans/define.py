"""Registration of queries: a function of Tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyloom.sources.bind import VIEWS, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(Tables) as a query; sql may use the bound views (and start with further ones)."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLES[name] = f"WITH RECURSIVE {VIEWS}, {body[5:]}" if body.startswith("WITH ") else f"WITH RECURSIVE {VIEWS} {body}"
        return f

    return put
