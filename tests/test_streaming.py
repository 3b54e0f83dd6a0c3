import datetime as dt

from tallyloom.streaming.activity import daily_counts, read_events


def test_daily_counts_closes_days(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, d, 5), 1, "view", 0.0, "{}") for i, d in enumerate([1, 1, 2, 9])]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(folder)
    q = daily_counts(read_events(spark, folder)).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["day"].day, r["n"]) for r in spark.table("daily").collect()}
    assert (1, 2) in got and (2, 1) in got and 9 not in {d for d, _ in got}
