"""Keyed stateful operators: sliding-window admission and runs of zeros, with one logic for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "key long, event_id long, ts timestamp, admitted boolean"


def admit(events: list[tuple], accepted: list[int], limit: int, window_us: int) -> tuple[list[bool], list[int]]:
    """Verdicts for events (time in microseconds, in order) after the accepted ones so far, and the accepted times still in reach.

    An event is admitted while fewer than `limit` accepted ones lie in the window before it; rejected events don't count; a limit
    of 0 or less admits all.
    """
    out = []
    for at in events:
        accepted = [t for t in accepted if t > at - window_us]
        ok = limit <= 0 or len(accepted) < limit
        if ok and limit > 0:
            accepted.append(at)
        out.append(ok)
    return out, accepted


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _spans(events: DataFrame, window_s: int, buckets: int = 64) -> DataFrame:
    """events with `span`, the time at which what came before stops to matter: the last event of the key with no other in the window
    before it.

    Times are cut into buckets of many windows; a bucket's rows are looked at together, and between buckets only one row each is passed
    on. So the rows of a key are spread over its buckets, however many they are.
    """
    # wall-clock times keep their distances, whatever the session's zone
    ntz = dict(events.dtypes)["ts"] == "timestamp_ntz"
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if ntz else F.unix_micros("ts")
    width = F.lit(buckets * window_s * 1_000_000)
    rows = events.select("key", "event_id", "ts").withColumns({"at": micros, "bucket": F.floor(micros / width).cast("long")})
    last = rows.groupBy("key", "bucket").agg(F.max("at").alias("before")).withColumn("bucket", F.col("bucket") + 1)
    in_bucket = W.partitionBy("key", "bucket").orderBy("at", "event_id")
    rows = rows.join(last, ["key", "bucket"], "left").withColumn("previous", F.coalesce(F.lag("at").over(in_bucket), F.col("before")))
    fresh = F.col("previous").isNull() | (F.col("at") - F.col("previous") >= window_s * 1_000_000)
    rows = rows.withColumn("own", F.max(F.when(fresh, F.col("at"))).over(in_bucket))
    # one row for each key and bucket
    carried = rows.groupBy("key", "bucket").agg(F.max("own").alias("newest"))
    carried = carried.withColumn("carried", F.max("newest").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    return rows.join(carried.select("key", "bucket", "carried"), ["key", "bucket"]).select("key", "event_id", "ts", F.coalesce("own", "carried").alias("span"))


def admission(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Batch: events (key, event_id, ts) with admitted, by key in the order of time and id.

    Spans of a key that can't influence each other are dealt to tasks on their own, and a task walks its rows in order with the
    accepted times of one span in hand, batch by batch: no key has to fit anywhere, and one with very many events is parted wherever it
    falls silent for a window. Null keys are one key; null times come first and stand in each other's window.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, accepted = None, []
        for batch in batches:
            verdicts = []
            parts = batch[["key", "span"]].astype("string").fillna("null").agg("|".join, axis=1).to_numpy()
            times = _micros(batch["ts"])
            for part, at in zip(parts, times):
                if part != now:
                    now, accepted = part, []
                (ok,), accepted = admit([at], accepted, limit, window_s * 1_000_000)
                verdicts.append(ok)
            yield batch[["key", "event_id", "ts"]].assign(admitted=verdicts)

    spread = _spans(events, window_s).repartition("key", "span").sortWithinPartitions("key", "span", "ts", "event_id")
    return spread.mapInPandas(walk, ADMITTED)


def admission_stream(events: DataFrame, limit: int, window_s: int, delay: str = "10 minutes") -> DataFrame:
    """Stream: as `admission`, state by key with the accepted times in the window; disorder has to stay within the watermark's delay.

    A key's state goes once the watermark is past the window of its last accepted event, so keys that fall silent cost nothing.
    """

    def group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches)).sort_values(["ts", "event_id"], ignore_index=True)
        before = list(state.get[0]) if state.exists else []
        own["admitted"], after = admit(_micros(own["ts"]), before, limit, window_s * 1_000_000)
        if after:
            state.update((after,))
            state.setTimeoutTimestamp(max(max(after) // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield own

    return (
        events.select("key", "event_id", "ts").withWatermark("ts", delay).groupBy("key")
        .applyInPandasWithState(group, ADMITTED, "accepted array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def run_onset_stream(days: DataFrame, length: int = 7) -> DataFrame:
    """Stream of (key, day_no, sold): a row when a key reaches `length` days without sales in a row. State: the run so far, for keys in one."""

    def group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        found = []
        for day, sold in pd.concat(list(batches)).sort_values("day_no")[["day_no", "sold"]].itertuples(index=False):
            run = run + 1 if sold == 0 else 0
            if run == length:
                found.append((key[0], int(day)))
        if run:
            state.update((run,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["key", "day_no"]).astype({"key": "int64", "day_no": "int64"})

    return days.groupBy("key").applyInPandasWithState(group, "key long, day_no long", "run long", "append", GroupStateTimeout.NoTimeout)


def user_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), "event_id", "ts")
