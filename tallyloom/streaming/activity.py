"""Daily activity counters over a stream of events (an extension: the counters as a stream).

Days close when the watermark has passed them; events later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events from parquet files as they appear in a folder."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """user_id, day, kind, n for each closed day."""
    day = F.window("ts", "1 day")
    counts = events.withWatermark("ts", late).groupBy("user_id", F.col("event_type").alias("kind"), day).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.to_date("window.start").alias("day"), "kind", "n")
