"""Short-time spectra of packed signals (signal_id, x array) and what is made of them, in Arrow batches and joins.

A signal is padded by half a window at both ends (reflected), so frame t is centred on
sample t * hop.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.vectors import mel_spectrogram, mel_weights, taper


def stft_padding(length: int, window: int, hop: int, match_stride: bool = False) -> tuple[int, int]:
    """(samples to add on the right, samples to add on both sides) so that a signal has ceil(length / hop) frames; only for hop = window / 4."""
    if not match_stride:
        return 0, 0
    if hop * 4 != window:
        raise ValueError("match_stride needs a hop of a quarter of the window")
    return -(-length // hop) * hop - length, (window - hop) // 2


def fft_length(window: int) -> int:
    """Spectra have as many points as the window, so that filters and frames fit."""
    return window


def _reflected(x: np.ndarray, side: int) -> np.ndarray:
    """numpy's reflection; a signal too short for it is extended by zeros first, as far as it takes."""
    if side >= len(x):
        x = np.append(x, np.zeros(side - len(x) + 1))
    return np.pad(x, side, mode="reflect")


def stft_array(x: np.ndarray, window: int, hop: int, shape: str = "hann", match_stride: bool = False) -> np.ndarray:
    """(frames, window / 2 + 1) complex; with match_stride the two frames at either end are left out."""
    right, side = stft_padding(len(x), window, hop, match_stride)
    if match_stride:
        x = np.pad(_reflected(x, side), (0, right))
    padded = _reflected(x, window // 2)
    count = (len(padded) - window) // hop + 1
    at = np.arange(count)[:, None] * hop + np.arange(window)
    spec = np.fft.rfft(padded[at] * np.asarray(taper(shape, window)))
    return spec[2:-2] if match_stride else spec


def istft_array(spec: np.ndarray, window: int, hop: int, length: int, shape: str = "hann", match_stride: bool = False) -> np.ndarray:
    """Overlap-add of the inverse frames over the sum of squared windows, cut to length."""
    if match_stride:
        spec = np.pad(spec, ((2, 2), (0, 0)))
    w = np.asarray(taper(shape, window))
    size = window + hop * (len(spec) - 1)
    out, cover = np.zeros(size), np.zeros(size)
    for t, frame in enumerate(np.fft.irfft(spec, window) * w):
        out[t * hop : t * hop + window] += frame
        cover[t * hop : t * hop + window] += w * w
    begin = window // 2 + ((window - hop) // 2 if match_stride else 0)
    out = (out / np.maximum(cover, 1e-11))[begin : begin + length]
    return np.pad(out, (0, length - len(out)))


def stft(packed: DataFrame, window: int, hop: int, shape: str = "hann", match_stride: bool = False) -> DataFrame:
    """signal_id, frame, bin, re, im; null and empty signals have no frames."""

    def run(batches):
        for b in batches:
            for i, x in zip(b.column("signal_id").to_pylist(), b.column("x").to_pylist()):
                if not x:
                    continue
                spec = stft_array(np.asarray(x, float), window, hop, shape, match_stride)
                frames, bins = spec.shape
                yield pa.RecordBatch.from_arrays([pa.array([i] * spec.size, pa.int64()), pa.array(np.repeat(np.arange(frames), bins), pa.int64()), pa.array(np.tile(np.arange(bins, dtype=np.int32), frames)), pa.array(spec.real.ravel()), pa.array(spec.imag.ravel())], names=["signal_id", "frame", "bin", "re", "im"])

    return packed.select("signal_id", "x").mapInArrow(run, "signal_id long, frame long, bin int, re double, im double")


def istft(spec: DataFrame, lengths: DataFrame, window: int, hop: int, shape: str = "hann", match_stride: bool = False) -> DataFrame:
    """signal_id, x array of `len` samples from stft's rows and lengths (signal_id, len)."""
    bins = window // 2 + 1
    cells = spec.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct("frame", "bin", "re", "im"))).alias("s")).join(lengths.select("signal_id", "len"), "signal_id")
    flat = cells.select("signal_id", F.col("len").cast("long").alias("len"), F.transform("s", lambda c: c["re"]).alias("re"), F.transform("s", lambda c: c["im"]).alias("im"))

    def run(batches):
        for b in batches:
            out = []
            for n, re, im in zip(b.column("len").to_pylist(), b.column("re").to_pylist(), b.column("im").to_pylist()):
                out.append(istft_array((np.array(re) + 1j * np.array(im)).reshape(-1, bins), window, hop, n, shape, match_stride).tolist())
            yield pa.RecordBatch.from_arrays([b.column("signal_id"), pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "x"])

    return flat.mapInArrow(run, "signal_id long, x array<double>")


def magnitude_phase(spec: DataFrame) -> DataFrame:
    return spec.withColumns({"magnitude": F.hypot("re", "im"), "phase": F.atan2("im", "re")}).drop("re", "im")


def from_magnitude_phase(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"re": F.col("magnitude") * F.cos("phase"), "im": F.col("magnitude") * F.sin("phase")}).drop("magnitude", "phase")


def log_magnitude(spec: DataFrame, ref: float = 1.0, amin: float = 1e-5, top_db: float | None = 80.0) -> DataFrame:
    """signal_id, frame, bin, db: power against ref, not under the signal's largest less top_db."""
    db = 10 * F.log10(F.greatest(F.pow("re", 2) + F.pow("im", 2), F.lit(amin * amin))) - 10 * math.log10(max(amin * amin, ref))
    rows = spec.select("signal_id", "frame", "bin", db.alias("db"))
    if top_db is None:
        return rows
    if top_db < 0:
        raise ValueError("top_db must not be negative")
    return rows.withColumn("db", F.greatest("db", F.max("db").over(Window.partitionBy("signal_id")) - top_db))


def mask_frequencies(spec: DataFrame, low: float, high: float, sample_rate: float, bins: int, value: float = 0.0) -> DataFrame:
    """Sets the bins of low <= f < high to value."""
    if low >= high:
        raise ValueError("low must be below high")
    hz = F.col("bin") * (sample_rate / 2) / (bins - 1)
    inside = (hz >= low) & (hz < high)
    return spec.withColumns({"re": F.when(inside, value).otherwise(F.col("re")), "im": F.when(inside, 0.0).otherwise(F.col("im"))})


def mask_timesteps(spec: DataFrame, begin: float, end: float, sample_rate: float, value: float = 0.0) -> DataFrame:
    """Sets the frames of begin <= t < end seconds to value; a signal's frames lie evenly over its duration (column duration), both ends included."""
    if begin >= end:
        raise ValueError("begin must be before end")
    last = F.max("frame").over(Window.partitionBy("signal_id"))
    t = F.col("frame") * F.col("duration") / F.greatest(last, F.lit(1))
    inside = (t >= begin) & (t < end)
    return spec.withColumns({"re": F.when(inside, value).otherwise(F.col("re")), "im": F.when(inside, 0.0).otherwise(F.col("im"))})


def mel(spec: DataFrame, n_mels: int, bins: int, sample_rate: float) -> DataFrame:
    """signal_id, frame, mel, value."""
    rows = spec.withColumn("id", F.struct("signal_id", "frame"))
    return mel_spectrogram(rows, mel_weights(n_mels, bins, sample_rate)).select("id.signal_id", "id.frame", "mel", "value")


def compare_spectrograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """signal_id, frame, mel, difference over the frames and mels that both have."""
    return a.select("signal_id", "frame", "mel", F.col("value").alias("a")).join(b.select("signal_id", "frame", "mel", F.col("value").alias("b")), ["signal_id", "frame", "mel"]).select("signal_id", "frame", "mel", F.abs(F.col("a") - F.col("b")).alias("difference"))


def mel_loss(a: DataFrame, b: DataFrame, sample_rate: float, windows=(2048, 512), mels=(150, 80), floor: float = 1e-5, power: float = 2.0, mag_weight: float = 1.0, log_weight: float = 1.0, loss=lambda x, y: F.avg(F.abs(x - y))) -> DataFrame:
    """signal_id, loss: over several windows, `loss` of the mels and of the log10 of their floored power. a, b: packed signals."""
    total = None
    for window, n in zip(windows, mels, strict=True):
        bins = window // 2 + 1
        left, right = (mel(stft(x, window, window // 4), n, bins, sample_rate) for x in (a, b))
        log = lambda c: F.log10(F.pow(F.greatest(F.col(c), F.lit(floor)), power))
        rows = left.join(right.withColumnRenamed("value", "other"), ["signal_id", "frame", "mel"])
        part = rows.groupBy("signal_id").agg((log_weight * loss(log("value"), log("other")) + mag_weight * loss(F.col("value"), F.col("other"))).alias("loss"))
        total = part if total is None else total.unionAll(part)
    return total.groupBy("signal_id").agg(F.sum("loss").alias("loss"))


def byte_grid(rows: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """x, y (from the top), shade 0..255: an image's grey values, scaled between the least and the greatest value of each signal."""
    w = Window.partitionBy("signal_id")
    low, high, top = F.min(value).over(w), F.max(value).over(w), F.max(y).over(w)
    shade = F.when(high > low, F.floor((F.col(value) - low) / (high - low) * 255)).otherwise(0).cast("int")
    return rows.select("signal_id", F.col(x).alias("x"), (top - F.col(y)).alias("y"), shade.alias("shade"))
