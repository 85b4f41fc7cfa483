"""Stateful processors with value, list and map state and event-time timers.

State lies in RocksDB, one entry for each pane or waiting event, so an update writes what changed
and not all that a key holds. Results leave when the watermark passes their time; rows that come
later than the watermark are dropped, as everywhere in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors need this provider; it holds for streams that start afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows as one frame, or nothing; the key stays a plain Python text."""
    if not rows:
        return iter(())
    return iter([pd.DataFrame(rows, columns=columns).astype({columns[0]: object})])


class Anomalies(StatefulProcessor):
    """Readings far from the mean of a sliding window, when the window has closed.

    Map state: the readings of each pane (one slide) and their count, mean and squared deviations.
    A timer a window merges its panes and tests their readings; a pane goes with its last window.
    """

    def __init__(self, steps: int, step_us: int, sigmas: float) -> None:
        self.steps, self.step_us, self.sigmas = steps, step_us, sigmas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getMapState("readings", "pane long", "us array<long>, value array<double>")
        self.moments = handle.getMapState("moments", "pane long", "n long, mean double, dev double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            pane = frame["us"].to_numpy() // self.step_us
            for p in np.unique(pane).tolist():
                part = frame[pane == p]
                us, value = part["us"].tolist(), part["value"].tolist()
                if self.readings.containsKey((p,)):
                    old = self.readings.getValue((p,))
                    us, value = list(old[0]) + us, list(old[1]) + value
                else:
                    # The first reading of a pane sets the timers of all windows that hold it.
                    for start in range(p - self.steps + 1, p + 1):
                        self.handle.registerTimer((start + self.steps) * self.step_us // 1000)
                self.readings.updateValue((p,), (us, value))
                x = np.array(value)
                self.moments.updateValue((p,), (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.step_us - self.steps
        panes = [p for p in range(start, start + self.steps) if self.moments.containsKey((p,))]
        held = np.array([self.moments.getValue((p,)) for p in panes], dtype=np.float64).reshape(-1, 3)
        n = held[:, 0].sum()
        out = []
        if n >= 2:
            mean = float((held[:, 0] * held[:, 1]).sum() / n)
            sd = float(np.sqrt((held[:, 2].sum() + (held[:, 0] * (held[:, 1] - mean) ** 2).sum()) / (n - 1)))
            for p in panes:
                us, value = self.readings.getValue((p,))
                out += [(key[0], u, v, start * self.step_us, mean, sd) for u, v in zip(us, value, strict=True) if abs(v - mean) > self.sigmas * sd]
        if start in panes:
            self.readings.removeKey((start,))
            self.moments.removeKey((start,))
        return frames(out, ["key", "us", "value", "start", "mean", "sd"])

    def close(self) -> None:
        pass


def anomaly_stream(readings: DataFrame, key: str, ts: str, value: str, size: int = 3600, slide: int = 300, sigmas: float = 2.0, delay: str = "5 minutes") -> DataFrame:
    """(key, ts, value, window_start, mean, sd) of readings beyond `sigmas` deviations, per closed window.

    `size` and `slide` are seconds, slide a divisor of size. Readings without a value are left out.
    """
    use_rocksdb(readings.sparkSession)
    rows = readings.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"), F.col(value).cast("double").alias("value"))
    flagged = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Anomalies(size // slide, slide * 1_000_000, sigmas), outputStructType="key string, us long, value double, start long, mean double, sd double", outputMode="append", timeMode="EventTime"
    )
    return flagged.select(F.col("key").alias(key), F.timestamp_micros("us").alias(ts), F.col("value").alias(value), F.timestamp_micros("start").alias("window_start"), "mean", "sd")
