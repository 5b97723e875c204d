"""Event streams: watermarked windows, sessions, deduplication, interval joins, keyed state and merging sinks.

All take a streaming (or batch) DataFrame of events with a timestamp column; late events beyond the watermark are dropped by
Spark, and state older than it is removed, so its size follows the watermark and not the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, by: str, ts: str = "ts", size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by, n, volume) of tumbling or sliding windows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("volume")).select(F.col("w.start").alias("start"), by, "n", "volume")


def debounced(events: DataFrame, key: str, gap: str = "30 seconds", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, first, last, n): bursts of a key's events, each ended by a gap."""
    sessions = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key)
    return sessions.agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("s.start").alias("first"), "last", "n")


def distinct_events(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def followed_by(a: DataFrame, b: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, a_id, b_id, a_ts, b_ts): b after a of the same key within the gap; both sides keep state for that long only."""
    left = a.select(F.col(key).alias("a_key"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    right = b.select(F.col(key).alias("b_key"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late)
    on = (F.col("a_key") == F.col("b_key")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {within}"))
    return left.join(right, on).select(F.col("a_key").alias(key), "a_id", "b_id", "a_ts", "b_ts")


def one_to_one(events: DataFrame, first: str, second: str, key: str, gap_s: int, late: str = "10 minutes") -> DataFrame:
    """(key, a_id, b_id, gap_s): each event of the first type with the earliest later one of the second that isn't taken.

    The state of a key is its open events of the first type, none older than the gap.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids = state.get if state.exists else ([], [])
        waiting = list(zip(times, ids, strict=True))
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for t, i, kind in zip(rows["ts"], rows["event_id"], rows["event_type"], strict=True):
                at = t.timestamp()
                waiting = [w for w in waiting if at - w[0] <= gap_s]
                if kind == first:
                    waiting.append((at, int(i)))
                elif kind == second and waiting and waiting[0][0] < at:
                    start, a = waiting.pop(0)
                    out.append((k[0], a, int(i), at - start))
        else:
            waiting = []
        if waiting:
            state.update(([w[0] for w in waiting], [w[1] for w in waiting]))
            state.setTimeoutTimestamp(max(int((waiting[-1][0] + gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "a_id", "b_id", "gap_s"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col("event_type").isin(first, second)).select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, a_id long, b_id long, gap_s double", "times array<double>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merge_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key in a table of numbered snapshots; a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number > 0:
            new = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch)
        latest = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/{number}")

    return write
