"""Structured Streaming: hopping and session windows over events, and running per-key levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hopping_counts(events: DataFrame, size: str, hop: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of value by event_type and hopping window; what is later than `late` is dropped."""
    return _timed(events, late).groupBy(F.window("ts", size, hop), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def running_level(events: DataFrame, decay: float) -> DataFrame:
    """(user_id, level, n) after each batch: level = decay * level + (1 - decay) * value, in order of ts; state is two numbers a user."""

    def step(key, frames, state):
        level, n = state.get if state.exists else (0.0, 0)
        for frame in frames:
            for v in frame.sort_values("ts")["value"]:
                level, n = decay * level + (1 - decay) * v, n + 1
        state.update((level, n))
        yield pd.DataFrame({"user_id": [key[0]], "level": [level], "n": [n]})

    return events.select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, level double, n long", "level double, n long", "update", GroupStateTimeout.NoTimeout)
