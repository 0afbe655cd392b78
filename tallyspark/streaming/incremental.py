"""Structured Streaming forms: ingestion, deduplication, daily counters, sessions and the player filter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New Parquet files of events; the event time is a zoned timestamp, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n, cents; a day comes out once it can't change any more."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    return days.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def player_levels(events: DataFrame, lam: float, sigma2: float, noise: float, mu: float) -> DataFrame:
    """The mean-reverting level of each user after every batch; the state is the level, its variance and its time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        level, var, last = state.get if state.exists else (mu, sigma2, rows.ts.iloc[0].timestamp())
        for r in rows.itertuples():
            phi = math.exp(-lam * max(0.0, r.ts.timestamp() - last) / 86400)
            last = max(last, r.ts.timestamp())
            level, var = mu + phi * (level - mu), phi * phi * var + sigma2 * (1 - phi * phi)
            if r.value == r.value:
                gain = var / (var + noise)
                level, var = level + gain * (r.value - level), (1 - gain) * var
        state.update((level, var, last))
        yield pd.DataFrame([(key[0], level, var)], columns=["user_id", "level", "level_var"])

    return events.select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, level double, level_var double", "level double, var double, last double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that is there and stop: the nightly increment."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
