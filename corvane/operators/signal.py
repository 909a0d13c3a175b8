"""Ordered numeric signals in long form: (signal_id, n, x), n from 0 without gaps.

Everything is a window or an equi-join within a signal, partitioned by signal_id; frames
are found by arithmetic on n, never by a range join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_n() -> WindowSpec:
    return Window.partitionBy("signal_id").orderBy("n")


def whole() -> WindowSpec:
    return Window.partitionBy("signal_id")


def from_events(events: DataFrame) -> DataFrame:
    """events -> signal of whole cents: a signal for each user, ordered by ts."""
    w = Window.partitionBy("user_id").orderBy("ts")
    return events.select(F.col("user_id").alias("signal_id"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("long").alias("x"))


def pack(signal: DataFrame) -> DataFrame:
    """(signal_id, x array) in order of n."""
    return signal.groupBy("signal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("signal_id", F.posexplode("x").alias("n", "x")).withColumn("n", F.col("n").cast("long"))


def length(signal: DataFrame) -> DataFrame:
    return signal.withColumn("len", F.count("*").over(whole()))


def trim(signal: DataFrame, before: int, after: int) -> DataFrame:
    return length(signal).where((F.col("n") >= before) & (F.col("n") < F.col("len") - after)).select("signal_id", (F.col("n") - before).alias("n"), "x")


def pad(signal: DataFrame, left: int, right: int, mode: str = "constant", value=0) -> DataFrame:
    """Pads with a constant or by reflect, replicate or circular; only edge samples are copied, each to its new places."""
    rows = length(signal)
    n, size = F.col("n"), F.col("len")
    if mode == "constant":
        ends = rows.where("n = 0").select("signal_id", F.explode(F.concat(F.sequence(F.lit(0), F.lit(left - 1)) if left else F.array().cast("array<int>"), F.transform(F.sequence(F.lit(0), F.lit(right - 1)), lambda i: i + left + size.cast("int")) if right else F.array().cast("array<int>"))).alias("n")).select("signal_id", F.col("n").cast("long").alias("n"), F.lit(value).cast(signal.schema["x"].dataType).alias("x"))
        return rows.select("signal_id", (n + left).alias("n"), "x").unionAll(ends)
    places = {
        "reflect": [(n >= 1) & (n <= left), left - n, (n >= size - 1 - right) & (n < size - 1), left + 2 * (size - 1) - n],
        "circular": [n >= size - left, left - size + n, n < right, left + size + n],
    }
    if mode in places:
        a, to_a, b, to_b = places[mode]
        copies = F.array_compact(F.array(n + left, F.when(a, to_a), F.when(b, to_b)))
    elif mode == "replicate":
        none = F.array().cast("array<bigint>")
        head = F.when(n == 0, F.sequence(F.lit(0).cast("long"), F.lit(left - 1).cast("long"))).otherwise(none) if left else none
        tail = F.when(n == size - 1, F.transform(F.sequence(F.lit(1).cast("long"), F.lit(right).cast("long")), lambda i: i + n + left)).otherwise(none) if right else none
        copies = F.concat(F.array(n + left), head, tail)
    else:
        raise ValueError(f"unknown padding: {mode}")
    return rows.select("signal_id", F.explode(copies).alias("n"), "x")


def frames(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """(signal_id, frame, i, x): complete frames of size samples every hop. Each sample goes to the frames that hold it."""
    last = F.floor((F.col("len") - size) / hop)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") - size + 1) / hop))
    hi = F.least(last, F.floor(F.col("n") / hop))
    return length(signal).where((F.col("len") >= size) & (lo <= hi)).select("signal_id", "n", "x", F.explode(F.sequence(lo, hi)).alias("frame")).select("signal_id", "frame", (F.col("n") - F.col("frame") * hop).alias("i"), "x")


def overlap_add(framed: DataFrame, hop: int) -> DataFrame:
    """Sum of the frames at each sample and how many cover it."""
    return framed.groupBy("signal_id", (F.col("frame") * hop + F.col("i")).alias("n")).agg(F.sum("x").alias("total"), F.count("*").alias("cover"))


def triangular_overlap_add(framed: DataFrame, size: int, hop: int) -> DataFrame:
    """Weighted overlap-add; the weight is 0.5 - |t - 0.5| at the inner points of 0..1 in size + 2 points."""
    t = (F.col("i") + 1) / (size + 1.0)
    w = 0.5 - F.abs(t - 0.5)
    return framed.groupBy("signal_id", (F.col("frame") * hop + F.col("i")).alias("n")).agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"))


def segments(signal: DataFrame, size: int, stride: int) -> DataFrame:
    """(signal_id, segment, i, x): a segment every stride samples while the signal lasts; the last ones are short."""
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") - size + 1) / stride))
    return signal.select("signal_id", "n", "x", F.explode(F.sequence(lo, F.floor(F.col("n") / stride))).alias("segment")).select("signal_id", "segment", (F.col("n") - F.col("segment") * stride).alias("i"), "x")


def preemphasis(signal: DataFrame, coefficient: float) -> DataFrame:
    """x[n-1] - c x[n], the correlation form."""
    return signal.select("signal_id", "n", (F.lag("x", 1, 0).over(by_n()) - coefficient * F.col("x")).alias("x"))


def roll(signal: DataFrame, by: int) -> DataFrame:
    """Circular shift to the right."""
    return length(signal).select("signal_id", F.pmod(F.col("n") + by, F.col("len")).alias("n"), "x")


def pool(signal: DataFrame, stride: int) -> DataFrame:
    """Mean of each stride samples (full ones only), repeated at every sample of it."""
    rows = length(signal).withColumn("block", F.floor(F.col("n") / stride)).where(f"(block + 1) * {stride} <= len")
    return rows.withColumn("x", F.avg("x").over(Window.partitionBy("signal_id", "block"))).select("signal_id", "n", "x")


def deinterleave(signal: DataFrame, channels: int = 2) -> DataFrame:
    """LRLR -> (signal_id, channel, n, x); samples of an incomplete last frame are dropped."""
    rows = length(signal).where(F.col("n") < F.col("len") - F.col("len") % channels)
    return rows.select("signal_id", (F.col("n") % channels).cast("int").alias("channel"), F.floor(F.col("n") / channels).alias("n"), "x")


def interleave(rows: DataFrame, channels: int = 2) -> DataFrame:
    return rows.select("signal_id", (F.col("n") * channels + F.col("channel")).alias("n"), "x")


def to_mono(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signal_id", "n").agg(F.avg("x").alias("x"))


def fir(signal: DataFrame, taps: list[float], delay: int = 0) -> DataFrame:
    """y[n] = sum taps[j] x[n + delay - j], zero outside: lags of one window, no join."""
    terms = [F.lit(t) * F.lag("x", j - delay, 0).over(by_n()) for j, t in enumerate(taps) if t]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return signal.select("signal_id", "n", total.alias("x"))


def low_pass_taps(cutoff: float, size: int = 51) -> list[float]:
    """Hamming-windowed sinc of unit gain at zero frequency; cutoff as a share of the sampling rate."""
    mid = (size - 1) / 2
    h = [(2 * cutoff if i == mid else math.sin(2 * math.pi * cutoff * (i - mid)) / (math.pi * (i - mid))) * (0.54 - 0.46 * math.cos(2 * math.pi * i / (size - 1))) for i in range(size)]
    return [x / sum(h) for x in h]


def high_pass_taps(cutoff: float, size: int = 51) -> list[float]:
    """Spectral inversion of the low-pass, normalised by the sum of magnitudes."""
    h = [-x for x in low_pass_taps(cutoff, size)]
    h[(size - 1) // 2] += 1
    total = sum(map(abs, h))
    return [x / total for x in h]


def tremolo(signal: DataFrame, rate: float, depth: float, seconds: float) -> DataFrame:
    """x (1 - d + d sin(2 pi r t)), t over 0..seconds with both ends."""
    t = F.col("n") * seconds / (F.col("len") - 1)
    return length(signal).select("signal_id", "n", (F.col("x") * (1 - depth + depth * F.sin(2 * math.pi * rate * t))).alias("x"))


def distortion(x: Column, amount: float, mix: float) -> Column:
    return (1 - mix) * x + mix * F.tanh(x * (1 + 10 * amount))


def layer_norm(signal: DataFrame, eps: float = 1e-5) -> DataFrame:
    mean, var = F.avg("x").over(whole()), F.var_pop("x").over(whole())
    return signal.select("signal_id", "n", ((F.col("x") - mean) / F.sqrt(var + eps)).alias("x"))


def statistics(signal: DataFrame) -> DataFrame:
    return signal.groupBy("signal_id").agg(F.count("*").alias("len"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def gated_block_energy(signal: DataFrame, size: int, hop: int, floor: int, ratio: int) -> DataFrame:
    """Two-gate block energy: blocks over floor, then those over 1/ratio of their mean; sum and count of what is left.

    Energies are whole numbers, so sums are exact.
    """
    blocks = frames(signal, size, hop).groupBy("signal_id", "frame").agg(F.sum(F.col("x") * F.col("x")).alias("e")).where(F.col("e") > floor)
    w = Window.partitionBy("signal_id")
    gated = blocks.withColumns({"s": F.sum("e").over(w), "c": F.count("*").over(w)}).where(F.col("e") * F.col("c") * ratio > F.col("s"))
    return gated.groupBy("signal_id").agg(F.count("*").alias("blocks"), F.sum("e").alias("energy"))


def wave(spark, shape: str, frequency: float, seconds: float, samples: int, signal_id: int = 0) -> DataFrame:
    """A sine, square, sawtooth or triangle over 0..seconds, both ends included; an unknown shape raises."""
    p = F.col("id") * (seconds / max(1, samples - 1)) * frequency
    saw = 2 * (p - F.floor(p + 0.5))
    shapes = {"sine": F.sin(2 * F.pi() * p), "square": F.signum(F.sin(2 * F.pi() * p)), "sawtooth": saw, "triangle": 2 * F.abs(saw) - 1}
    if shape not in shapes:
        raise ValueError(f"unknown shape: {shape}")
    return spark.range(samples).select(F.lit(signal_id).cast("long").alias("signal_id"), F.col("id").alias("n"), shapes[shape].alias("x"))


def zeros(spark, samples: int, signals: int = 1) -> DataFrame:
    return spark.range(samples * signals).select(F.floor(F.col("id") / samples).alias("signal_id"), (F.col("id") % samples).alias("n"), F.lit(0.0).alias("x"))


def batch(signal: DataFrame, how: str = "raise") -> DataFrame:
    """Signals of one length: the shorter ones padded with zeros, the longer ones truncated, or an error if they differ."""
    sizes = signal.groupBy("signal_id").agg((F.max("n") + 1).alias("len"))
    ends = sizes.agg(F.min("len").alias("least"), F.max("len").alias("most"))
    if how == "truncate":
        return signal.join(F.broadcast(ends), F.col("n") < F.col("least")).select(*signal.columns)  # one row
    if how == "pad":
        fill = sizes.join(F.broadcast(ends), F.col("len") < F.col("most")).select("signal_id", F.explode(F.sequence("len", F.col("most") - 1)).alias("n"), F.lit(0).cast(signal.schema["x"].dataType).alias("x"))
        return signal.select("signal_id", "n", "x").unionAll(fill)
    if how != "raise":
        raise ValueError(f"unknown way: {how}")
    row = ends.first()
    if row["least"] != row["most"]:
        raise ValueError(f"signals have from {row['least']} to {row['most']} samples: pad or truncate them")
    return signal


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def select_signals(signal: DataFrame, ids: list[int]) -> DataFrame:
    return signal.where(F.col("signal_id").isin(ids))
