"""Structured Streaming with state: overlap-add on arrival, rolling context, codebook updates a batch, token streams that end, arrival rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def overlap_add(chunks: DataFrame, hop_seconds: int, late: str = "1 hour") -> DataFrame:
    """Chunks (signal_id, ts of their first sample, hop_seconds a sample, x array) -> window start, signal_id, total, cover of each sample as it closes.

    A sample is closed, and given out, once the watermark has passed it; later chunks no longer change it.
    """
    at = F.timestamp_seconds(F.unix_seconds("ts") + F.col("i") * hop_seconds)
    rows = chunks.select("signal_id", "ts", F.posexplode("x").alias("i", "x")).withColumn("at", at).withWatermark("at", late)
    return rows.groupBy(F.window("at", f"{hop_seconds} seconds"), "signal_id").agg(F.sum("x").alias("total"), F.count("*").alias("cover")).select(F.col("window.start").alias("at"), "signal_id", "total", "cover")


def rolling_context(events: DataFrame, size: int) -> DataFrame:
    """(key, ts, value) -> key, n, offset, mean after each batch: the last `size` values are the state, offset counts those before them."""

    def step(key, frames, state):
        kept, n = state.get if state.exists else ([], 0)
        kept = list(kept)
        for frame in frames:
            values = frame.sort_values("ts")["value"].tolist()
            kept, n = (kept + values)[-size:], n + len(values)
        state.update((kept, n))
        yield pd.DataFrame({"key": [key[0]], "n": [len(kept)], "offset": [n - len(kept)], "mean": [sum(kept) / len(kept) if kept else 0.0]})

    return events.select("key", "ts", "value").groupBy("key").applyInPandasWithState(step, "key long, n long, offset long, mean double", "kept array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def ending_streams(tokens: DataFrame, end: int, steps: int) -> DataFrame:
    """(stream, ts, token) -> stream, tokens, done after each batch: a stream is done `steps` tokens after its first `end`, and takes no more."""

    def step(key, frames, state):
        n, left = state.get if state.exists else (0, -1)
        for frame in frames:
            for token in frame.sort_values("ts")["token"]:
                if left == 0:
                    break
                n += 1
                left = left - 1 if left > 0 else steps if token == end else left
        state.update((n, left))
        yield pd.DataFrame({"stream": [key[0]], "tokens": [n], "done": [left == 0]})

    return tokens.select("stream", "ts", "token").groupBy("stream").applyInPandasWithState(step, "stream long, tokens long, done boolean", "n long, left long", "update", GroupStateTimeout.NoTimeout)


def arrival_rate(events: DataFrame, seconds: int, per_second: float, late: str = "1 hour") -> DataFrame:
    """start, n, rate (a second) and factor (rate over what one second of output needs) of each window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"), (F.col("n") / seconds / per_second).alias("factor"))


def codebook_updates(vectors: DataFrame, path: str, start: DataFrame, decay: float):
    """A stream writer that moves the codebook (code, size, total) at path toward each batch of (id, vec): one table a batch, path/batch=N.

    A batch that is run again after a failure overwrites its own table, so it counts once.
    """
    from corvane.operators.vectors import ema_update, nearest

    start.write.mode("overwrite").parquet(f"{path}/batch=-1")

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        codes = spark.read.parquet(f"{path}/batch={number - 1}")
        book = codes.select("code", F.transform("total", lambda x: F.round(x / F.col("size")).cast("long")).alias("vec"))
        hit = nearest(batch, book).select("code", F.posexplode("vec").alias("d", "v"))
        sums = hit.groupBy("code", "d").agg(F.sum("v").cast("double").alias("s"), F.count("*").alias("c"))
        seen = sums.groupBy("code").agg(F.max("c").alias("count"), F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("sum"))
        ema_update(codes, seen, decay).select("code", "size", "total").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return vectors.writeStream.foreachBatch(update)
