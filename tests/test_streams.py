"""Admission against a plain walk, and state that goes."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from shelfwise.streaming.stateful import admission, admission_stream

T0 = dt.datetime(2024, 1, 1)


def plain(rows, limit, window):
    out, accepted = {}, {}
    for key, event, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        inside = [t for t in accepted.get(key, []) if t > ts - dt.timedelta(seconds=window)]
        out[key, event] = limit <= 0 or len(inside) < limit
        accepted[key] = [*inside, ts] if out[key, event] else inside
    return out


def test_admission_equals_a_plain_walk(spark):
    """One key with most of the rows, bursts and silences, equal times, times across many buckets."""
    rng = np.random.default_rng(9)
    rows = []
    for key, n, scale in ((1, 900, 3), (2, 60, 40), (3, 40, 4000), (4, 1, 1)):
        at = np.cumsum(rng.integers(0, scale, n))
        rows += [(key, 1000 * key + k, T0 + dt.timedelta(seconds=int(a))) for k, a in enumerate(at)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp")
    for limit, window in ((3, 10), (1, 7), (0, 10), (5, 100)):
        for partitions in (2, 7):
            got = {(r.key, r.event_id): r.admitted for r in admission(df.repartition(partitions), limit, window).collect()}
            assert got == plain(rows, limit, window)
    wall = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {(r.key, r.event_id): r.admitted for r in admission(wall, 3, 10).collect()} == plain(rows, 3, 10)
    assert admission(df.limit(0), 3, 10).count() == 0


def test_state_of_silent_keys_goes(spark, tmp_path):
    source = str(tmp_path / "events")

    def feed(rows):
        spark.createDataFrame(rows, "key long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)

    feed([(k, k, T0 + dt.timedelta(seconds=k)) for k in range(20)])
    stream = admission_stream(spark.readStream.schema("key long, event_id long, ts timestamp").parquet(source), 2, 60, "10 seconds")
    query = stream.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
        assert max(rows) == 20
        for k, later in enumerate((3600, 3700)):
            feed([(99, 100 + k, T0 + dt.timedelta(seconds=later))])
            query.processAllAvailable()
        rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
        assert rows[-1] <= 1
        assert spark.table("silent").where(F.col("admitted")).count() == 22
    finally:
        query.stop()
