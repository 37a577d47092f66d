"""Beyond batch: rounds as micro-batches over a stream of events (ts, key, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and means by window; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def smoothed(events: DataFrame, span: int = 30, by: str = "event_type") -> DataFrame:
    """The running exponentially weighted mean of each key, its sums kept as state between micro-batches."""
    q = 1 - 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, t, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            s, t, n = s * q + v, t * q + 1, n + 1
        state.update((float(s), float(t), int(n)))
        yield pd.DataFrame({by: [key[0]], "n": [n], "ewma": [s / t]})

    return events.groupBy(by).applyInPandasWithState(step, f"{by} string, n long, ewma double", "s double, t double, n long", "update", "NoTimeout")
