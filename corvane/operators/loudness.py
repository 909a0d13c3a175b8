"""Integrated loudness of signals in long form (signal_id, channel, n, x), gated in two steps, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import effects

#: Channel weights, offset in decibels, gates (fixed values).
CHANNEL_WEIGHTS, OFFSET, ABSOLUTE_GATE, RELATIVE_GATE = (1.0, 1.0, 1.0, 1.41, 1.41), -0.691, -70.0, -10.0
LEAST_SECONDS = 0.5


def weighted(signal: DataFrame) -> DataFrame:
    """signal with K-weighted x; each channel is filtered by itself."""
    channel = F.struct("signal_id", "channel")
    packed = signal.groupBy(channel.alias("c")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("x").cast("double").alias("x")))), lambda s: s["x"]).alias("x"))
    numbered = packed.select((F.col("c.signal_id") * len(CHANNEL_WEIGHTS) + F.col("c.channel")).alias("signal_id"), "x")
    out = effects.k_weighting(numbered).select("signal_id", F.posexplode("x").alias("n", "x"))
    return out.select(F.floor(F.col("signal_id") / len(CHANNEL_WEIGHTS)).alias("signal_id"), F.pmod("signal_id", F.lit(len(CHANNEL_WEIGHTS))).cast("int").alias("channel"), F.col("n").cast("long").alias("n"), "x")


def decibels(power: Column) -> Column:
    return OFFSET + 10 * F.log10(power)


def block_powers(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """signal_id, block, channel, z: mean square of each complete block of size samples every hop."""
    rows = signal.withColumn("len", F.max("n").over(Window.partitionBy("signal_id", "channel")) + 1).where(F.col("len") >= size)
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") - size + 1) / hop))
    high = F.least(F.floor((F.col("len") - size) / hop), F.floor(F.col("n") / hop))
    blocks = rows.where(low <= high).select("signal_id", "channel", "x", F.explode(F.sequence(low, high)).alias("block"))
    return blocks.groupBy("signal_id", "block", "channel").agg((F.sum(F.col("x") * F.col("x")) / size).alias("z"))


def integrated(signal: DataFrame, sample_rate: int, seconds: float = 0.4, overlap: float = 0.75, absolute: float = ABSOLUTE_GATE, relative: float = RELATIVE_GATE) -> DataFrame:
    """signal_id, blocks (after both gates), loudness; null where no block passes.

    Blocks louder than the absolute gate give the mean power of each channel; those
    louder than that mean's loudness less 10 dB give the result.
    """
    size = int(seconds * sample_rate)
    hop = int(seconds * sample_rate * (1 - overlap))
    gain = F.get(F.array(*[F.lit(w) for w in CHANNEL_WEIGHTS]), F.col("channel"))
    z = block_powers(weighted(signal), size, hop).withColumn("g", gain * F.col("z"))
    blocks = z.groupBy("signal_id", "block").agg(F.sum("g").alias("g")).withColumn("l", F.when(F.col("g") > 0, decibels(F.col("g")))).where(F.col("l") > absolute)
    w = Window.partitionBy("signal_id")
    passed = blocks.withColumn("gate", decibels(F.avg("g").over(w)) + relative).where("l > gate")
    out = passed.groupBy("signal_id").agg(F.count("*").alias("blocks"), decibels(F.avg("g")).alias("loudness"))
    return signal.select("signal_id").distinct().join(out, "signal_id", "left").select("signal_id", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"), "loudness")


def loudness(signal: DataFrame, sample_rate: int, floor: float = ABSOLUTE_GATE, **kw) -> DataFrame:
    """signal_id, loudness: signals of less than half a second are filled with zeros up to it; never under floor."""
    least = int(LEAST_SECONDS * sample_rate)
    size = signal.groupBy("signal_id", "channel").agg(F.max("n").alias("last")).where(F.col("last") + 1 < least)
    zeros = size.select("signal_id", "channel", F.explode(F.sequence(F.col("last") + 1, F.lit(least - 1).cast("long"))).alias("n"), F.lit(0.0).alias("x"))
    whole = signal.select("signal_id", "channel", "n", F.col("x").cast("double").alias("x")).unionAll(zeros)
    out = integrated(whole, sample_rate, **kw)
    return out.select("signal_id", F.greatest(F.coalesce("loudness", F.lit(floor)), F.lit(floor)).alias("loudness"))


def normalize(signal: DataFrame, target: float, sample_rate: int, **kw) -> DataFrame:
    """signal scaled to the target loudness."""
    gain = loudness(signal, sample_rate, **kw).select("signal_id", F.exp((target - F.col("loudness")) * 0.1151292546497023).alias("gain"))  # ln(10) / 20
    return signal.join(gain, "signal_id").withColumn("x", F.col("x") * F.col("gain")).drop("gain")


def hashed(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed, the same in every run."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def excerpt(signal: DataFrame, samples: int, seed: int, offset: int = 0) -> DataFrame:
    """signal cut to `samples` from a start drawn for each signal from offset to the last one that leaves enough."""
    size = F.max("n").over(Window.partitionBy("signal_id")) + 1
    room = F.greatest(F.col("len") - samples - offset + 1, F.lit(1))
    start = F.lit(offset) + F.floor(hashed(F.col("signal_id"), seed) * room)
    rows = signal.withColumn("len", size).withColumn("start", start).where((F.col("n") >= F.col("start")) & (F.col("n") < F.col("start") + samples))
    return rows.withColumn("n", F.col("n") - F.col("start")).drop("len", "start")


def salient_excerpt(signal: DataFrame, samples: int, seed: int, sample_rate: int, cutoff: float = -40.0, tries: int = 8, **kw) -> DataFrame:
    """The first of `tries` excerpts that is louder than cutoff, else the last, with its number `try`."""
    if tries < 1:
        raise ValueError("at least one try")
    drawn = None
    for t in range(tries):
        one = excerpt(signal, samples, seed + t).withColumn("try", F.lit(t))
        drawn = one if drawn is None else drawn.unionAll(one)
    each = drawn.withColumn("signal_id", F.col("signal_id") * tries + F.col("try"))
    level = loudness(each.drop("try"), sample_rate, **kw).select(F.floor(F.col("signal_id") / tries).alias("signal_id"), F.pmod("signal_id", F.lit(tries)).cast("int").alias("try"), "loudness")
    best = level.groupBy("signal_id").agg(F.coalesce(F.min(F.when(F.col("loudness") > cutoff, F.col("try"))), F.lit(tries - 1)).alias("try"))
    return drawn.join(best, ["signal_id", "try"])
