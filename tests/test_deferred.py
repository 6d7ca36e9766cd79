"""Deferred requests settled on a stream and on a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from routeloom.sources.tables import requests, table
from routeloom.streaming.deferred import settled_stream, settled_table
from routeloom.streaming.routes import counts_by_window, file_stream, route_stream

DIR = "/root/testdata/sf0.001"


def _requests(spark):
    return requests(spark, DIR).join(table(spark, DIR, "events").select("event_id", F.col("user_id"), F.col("ts").cast("timestamp").alias("ts")), "event_id")


def test_stream_equals_table(spark, tmp_path):
    limit, rows = timedelta(hours=30), _requests(spark)
    want = settled_table(rows, "user_id", "ts", limit)
    assert {r.outcome for r in want.select("outcome").distinct().collect()} == {"returned", "expired"}
    # three files out of order within days, with repeated rows, then a last event that moves the watermark on
    span = rows.agg(F.min("ts"), F.max("ts")).first()
    third = (span[1] - span[0]) / 3
    for i in range(3):
        a, b = span[0] + i * third, span[0] + (i + 1) * third + timedelta(seconds=1)
        part = rows.where((F.col("ts") >= a) & (F.col("ts") < b if i < 2 else F.lit(True)))
        part.unionByName(part.where("event_id % 9 = 0")).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            query = settled_stream(file_stream(spark, str(tmp_path / "in"), rows.schema, 1), "user_id", "ts", limit, key="event_id", late="2 days").writeStream.format("memory").queryName("settled").outputMode("append").start()
        query.processAllAvailable()
    end = rows.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "ts": F.lit(datetime(2100, 1, 1)), "connectivity": F.lit("good")})
    end.select(*rows.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    got, cols = spark.table("settled"), ["event_id", "connectivity", "settled_at", "outcome", "route", "reason"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_hand_case(spark):
    base = _requests(spark).where("connectivity = 'none'").limit(1).drop("event_id", "user_id", "ts", "connectivity", "capability", "actuation", "distraction")
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    events = [(1, 7, at(0), "none"), (2, 7, at(1), "none"), (3, 7, at(3), "weak"), (4, 7, at(4), "none"), (5, 7, at(12), "good"), (6, 8, at(0), "none"), (7, 9, at(0), "good"), (8, 9, at(0), "none")]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, connectivity string").crossJoin(base).withColumns({"capability": F.lit("needs_cloud"), "actuation": F.lit("none"), "distraction": F.lit("low")})
    got = {r.event_id: (r.outcome, r.connectivity, r.route == "DEFER") for r in settled_table(df, "user_id", "ts", timedelta(hours=5)).collect()}
    assert got == {1: ("returned", "weak", False), 2: ("returned", "weak", False), 4: ("expired", "none", True), 6: ("expired", "none", True), 8: ("expired", "none", True)}


def test_counts_by_window_equal_batch(spark, tmp_path):
    rows = _requests(spark)
    rows.write.parquet(str(tmp_path / "in"))
    q = counts_by_window(route_stream(file_stream(spark, str(tmp_path / "in"), rows.schema))).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = route_stream(rows).groupBy(F.window("ts", "1 hour"), "route").agg(F.count("*").alias("n"))
    assert sorted(map(str, spark.table("counted").collect())) == sorted(map(str, want.collect()))
