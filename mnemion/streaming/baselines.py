"""A moving baseline a key over a stream, in typed state with timers. Needs the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Windows that make a baseline, and how many there must be.
RECENT, LEAST = 9, 3
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Baseline(StatefulProcessor):
    """Keeps a key's last volumes; puts out windows above `factor` times their mean. A key without a window for `idle_ms` is forgotten."""

    def __init__(self, factor: float, idle_ms: int):
        self.factor, self.idle_ms = factor, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "volumes array<double>, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        volumes, timer = self.recent.get() if self.recent.exists() else ([], 0)
        volumes, out = [float(x) for x in volumes], []
        for start, volume in pd.concat(list(rows)).sort_values("start")[["start", "volume"]].itertuples(index=False):
            if len(volumes) >= LEAST and volume > self.factor * (mean := sum(volumes) / len(volumes)):
                out.append((key[0], start, volume, mean, len(volumes)))
            volumes = [*volumes, float(volume)][-RECENT:]
            last = start
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(int(last.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(timer)
        self.recent.update((volumes, timer))
        yield pd.DataFrame(out, columns=["key", "start", "volume", "baseline", "samples"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        yield pd.DataFrame([], columns=["key", "start", "volume", "baseline", "samples"])

    def close(self) -> None:
        pass


def volume_spikes(events: DataFrame, by: str, value: str = "value", ts: str = "ts", size: str = "1 day", late: str = "1 hour", factor: float = 3.0, idle_days: int = 365) -> DataFrame:
    """(key, start, volume, baseline, samples): windows of a key whose volume is above `factor` times the mean of the up to nine before.

    Windows are put out once the watermark has passed them, in order, so what a replay finds is what the batch operator finds
    among closed windows; those without events are no sample in either.
    """
    if events.sparkSession.conf.get(PROVIDER[0]) != PROVIDER[1]:
        raise ValueError(f"set {PROVIDER[0]} to {PROVIDER[1]}")
    rows = events.select(F.col(by).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).where("key is not null").withWatermark("ts", late)
    windows = rows.groupBy(F.window("ts", size).alias("w"), "key").agg(F.sum("value").alias("volume")).select("key", F.col("w.start").alias("start"), F.window_time("w").alias("at"), "volume")
    kind = events.schema[by].dataType.simpleString()
    return windows.groupBy("key").transformWithStateInPandas(Baseline(factor, idle_days * 86_400_000), f"key {kind}, start timestamp, volume double, baseline double, samples long", outputMode="Append", timeMode="EventTime")
