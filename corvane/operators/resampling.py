"""Resampling and interpolation of ordered signals (signal_id, n, x) in windows and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPS = 129


def sinc_taps(up: int, down: int, size: int = TAPS) -> list[float]:
    """Hamming-windowed sinc with its cutoff at the lower of the two rates and a gain of `up`."""
    cutoff, mid = 0.5 / max(up, down), (size - 1) / 2
    h = [(2 * cutoff if i == mid else math.sin(2 * math.pi * cutoff * (i - mid)) / (math.pi * (i - mid))) * (0.54 - 0.46 * math.cos(2 * math.pi * i / (size - 1))) for i in range(size)]
    return [x / sum(h) * up for x in h]


def resample_rational(signal: DataFrame, up: int, down: int, taps: list[float] | None = None) -> DataFrame:
    """ceil(len up / down) samples: zeros between samples, a low-pass, every down-th sample.

    Only the products that are not zero are made: a sample is sent to the outputs that
    its taps reach, len(taps) / down of them.
    """
    if up < 1 or down < 1:
        raise ValueError("rates must be positive")
    g = math.gcd(up, down)
    up, down = up // g, down // g
    taps = taps or sinc_taps(up, down)
    half = len(taps) // 2
    size = F.max("n").over(Window.partitionBy("signal_id")) + 1
    n = F.col("n") * up  # its place among the zeros; output m lies at m * down
    first = F.greatest(F.ceil((n - half) / down), F.lit(0).cast("long"))
    last = F.least(F.floor((n + half) / down), F.ceil(F.col("len") * up / down) - 1)
    sent = signal.withColumn("len", size).where(first <= last).select("signal_id", "n", "x", F.explode(F.sequence(first, last)).alias("m"))
    table = F.array(*[F.lit(float(t)) for t in taps])
    tap = F.get(table, (F.col("m") * down - F.col("n") * up + half).cast("int"))
    return sent.groupBy("signal_id", F.col("m").alias("n")).agg(F.sum(F.col("x") * tap).alias("x"))


def interpolate(points: DataFrame, at: DataFrame) -> DataFrame:
    """signal_id, at, y: piecewise linear through points (signal_id, xp, fp), held beyond both ends, at the places of at (signal_id, at).

    One sort of both sides by place: an as-of join from either side, without a range join.
    Of points with equal xp the one with the lowest fp counts.
    """
    known = points.groupBy("signal_id", F.col("xp").cast("double").alias("place")).agg(F.min("fp").cast("double").alias("fp")).withColumn("kind", F.lit(0))
    asked = at.select("signal_id", F.col("at").cast("double").alias("place"), F.lit(None).cast("double").alias("fp"), F.lit(1).alias("kind"))
    w = Window.partitionBy("signal_id").orderBy("place", "kind")
    here = F.when(F.col("kind") == 0, F.struct("place", "fp"))
    before = F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = known.select("signal_id", "place", "fp", "kind").unionAll(asked).withColumns({"a": before, "b": after}).where("kind = 1")
    y = F.when(F.col("a").isNull(), F.col("b.fp")).when(F.col("b").isNull() | (F.col("place") == F.col("a.place")), F.col("a.fp")).otherwise(F.col("a.fp") + (F.col("b.fp") - F.col("a.fp")) * (F.col("place") - F.col("a.place")) / (F.col("b.place") - F.col("a.place")))
    return rows.select("signal_id", F.col("place").alias("at"), y.alias("y"))


def resample_linear(signal: DataFrame, source: int, target: int, align: bool = False) -> DataFrame:
    """floor(len target / source) samples; output i lies at i source / target, with align at i (len - 1) / (new - 1); the last sample is held.

    A sample makes the outputs between it and the next one, so a signal is never one row.
    """
    w = Window.partitionBy("signal_id")
    rows = signal.select("signal_id", "n", "x", F.lead("x").over(w.orderBy("n")).alias("next"), (F.max("n").over(w) + 1).alias("len"))
    new = F.floor(F.col("len") * target / source)
    rows = rows.withColumn("new", new).where("new > 0")
    if align:
        place: Column = (F.col("len") - 1) / F.greatest(F.col("new") - 1, F.lit(1))
    else:
        place = F.lit(source) / F.lit(target)
    # candidates by division, then those whose place is in [n, n + 1)
    low = F.when(place > 0, F.greatest(F.floor(F.col("n") / place) - 1, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    high = F.when(F.col("next").isNull() | (place == 0), F.col("new") - 1).otherwise(F.least(F.ceil((F.col("n") + 1) / place) + 1, F.col("new") - 1))
    out = rows.withColumn("step", place).where(low <= high).select("signal_id", "n", "x", "next", "len", "step", F.explode(F.sequence(low, high)).alias("i"))
    pos = F.col("i") * (F.col("len") - 1) / F.greatest(F.floor(F.col("len") * target / source) - 1, F.lit(1)) if align else F.col("i") * F.lit(source) / F.lit(target)
    out = out.withColumn("pos", pos).where(F.least(F.floor("pos"), F.col("len") - 1) == F.col("n"))
    return out.select("signal_id", F.col("i").alias("n"), (F.col("x") + (F.coalesce("next", "x") - F.col("x")) * (F.col("pos") - F.col("n"))).alias("x"))


def adjust_speed(signal: DataFrame, factor: float) -> DataFrame:
    """floor(len / factor) samples at even places from the first to the last."""
    if factor <= 0:
        raise ValueError("the speed must be positive")
    w = Window.partitionBy("signal_id")
    sized = signal.select("signal_id", "n", "x", (F.max("n").over(w) + 1).alias("len"))
    ends = sized.where("n = 0").withColumn("new", F.floor(F.col("len") / factor)).where("new > 0")
    at = ends.select("signal_id", "len", "new", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new") - 1)).alias("i")).withColumn("at", F.when(F.col("new") > 1, F.col("i") * (F.col("len") - 1) / (F.col("new") - 1)).otherwise(0.0))
    y = interpolate(signal.select("signal_id", F.col("n").alias("xp"), F.col("x").alias("fp")), at.select("signal_id", "at"))
    return y.withColumn("n", F.row_number().over(w.orderBy("at")) - 1).select("signal_id", F.col("n").cast("long").alias("n"), F.col("y").alias("x"))


def hz_to_bin(hz: Column, n_fft: int, sample_rate: float) -> Column:
    """The nearest of n_fft / 2 + 1 bins, the lower one in ties; beyond the last the last."""
    width = sample_rate / n_fft
    return F.least(F.greatest(F.ceil(hz / width - 0.5), F.lit(0).cast("long")), F.lit(n_fft // 2).cast("long"))
