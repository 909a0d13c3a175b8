"""Attention, position features and tensor contractions on long or packed vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(causal: bool = False, padded: bool = False) -> Column:
    """Whether a query (columns q_pos, q_pad) sees a key (k_pos, k_pad): causal sees no later one; with padding, padding sees padding and text sees text."""
    seen = F.lit(True)
    if causal:
        seen = seen & (F.col("k_pos") <= F.col("q_pos"))
    if padded:
        seen = seen & (F.col("q_pad") == F.col("k_pad"))
    return seen


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def attend(rows: DataFrame, causal: bool = False, padded: bool = False, scale: float | None = None) -> DataFrame:
    """(seq, pos, q, k, v, pad) -> seq, pos, keys (how many are seen), y: softmax(q k * scale) v over the keys of the same sequence; scale is 1 / sqrt(size) by default.

    A sequence's queries and keys meet in a join on seq: a context's length squared, as
    attention is. A query that sees no key has a null y.
    """
    q = rows.select("seq", F.col("pos").alias("q_pos"), F.col("pad").alias("q_pad"), "q")
    k = rows.select("seq", F.col("pos").alias("k_pos"), F.col("pad").alias("k_pad"), "k", "v")
    by = F.lit(scale) if scale is not None else 1 / F.sqrt(F.size("q"))
    pairs = q.join(k, "seq").where(allowed(causal, padded)).withColumn("score", dot(F.col("q"), F.col("k")) * by)
    most = F.max("score").over(Window.partitionBy("seq", "q_pos"))
    weighed = pairs.withColumn("w", F.exp(F.col("score") - most))
    cells = weighed.select("seq", "q_pos", "w", F.posexplode("v").alias("d", "x"))
    sums = cells.groupBy("seq", "q_pos", "d").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("y"), F.count("*").alias("keys"))
    out = sums.groupBy("seq", "q_pos").agg(F.max("keys").alias("keys"), F.transform(F.sort_array(F.collect_list(F.struct("d", "y"))), lambda c: c["y"]).alias("y"))
    every = rows.select("seq", "pos")
    return every.join(out.withColumnRenamed("q_pos", "pos"), ["seq", "pos"], "left").select("seq", "pos", F.coalesce("keys", F.lit(0).cast("long")).alias("keys"), "y")


def repeat_heads(rows: DataFrame, times: int) -> DataFrame:
    """(head, ...) with each head `times` times in a row: head * times + 0 .. times - 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("head", F.col("head") * times + F.col("copy")).drop("copy")


def sinusoid(position: Column, size: int, base: float = 10000.0) -> Column:
    """array<double>: sines, then cosines, of the position at size / 2 falling frequencies."""
    if size % 2:
        raise ValueError("the size must be even")
    angle = lambda i: position / F.pow(F.lit(base), 2.0 * i / size)
    steps = F.sequence(F.lit(0), F.lit(size // 2 - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))


def rope(vec: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary features: the first half of vec is turned against the second by position / base^(2i / size)."""
    half = (F.size(vec) / 2).cast("int")
    a, b = F.slice(vec, F.lit(1), half), F.slice(vec, half + 1, half)
    angle = lambda i: position / F.pow(F.lit(base), i / half)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    one = F.transform(pairs, lambda p, i: p["a"] * F.cos(angle(i)) - p["b"] * F.sin(angle(i)))
    two = F.transform(pairs, lambda p, i: p["b"] * F.cos(angle(i)) + p["a"] * F.sin(angle(i)))
    return F.concat(one, two)


def rotate_half(vec: Column) -> Column:
    """The second half negated, before the first."""
    half = (F.size(vec) / 2).cast("int")
    return F.concat(F.transform(F.slice(vec, half + 1, half), lambda x: -x), F.slice(vec, F.lit(1), half))


def l2_normalize(vec: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: x / F.greatest(norm, F.lit(eps)))


def rms_norm(vec: Column, eps: float = 1e-5, weight: Column | None = None) -> Column:
    by = F.sqrt(dot(vec, vec) / F.size(vec) + eps)
    out = F.transform(vec, lambda x: x / by)
    return out if weight is None else F.zip_with(out, weight, lambda x, w: x * w)


def weight_norm(vec: Column, gain: Column) -> Column:
    """gain * vec / |vec|; a zero vector stays zero."""
    norm = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: F.when(norm > 0, gain * x / norm).otherwise(0.0))


def contract(a: DataFrame, b: DataFrame, over: list[str], value: str = "x") -> DataFrame:
    """Sum of products of two sparse tensors (index columns and a value) over the index columns `over`; the others stay."""
    keep = [c for c in a.columns if c not in (*over, value)] + [c for c in b.columns if c not in (*over, value)]
    if len(set(keep)) < len(keep):
        raise ValueError("the indices that stay must have different names")
    joined = a.withColumnRenamed(value, "left_value").join(b.withColumnRenamed(value, "right_value"), over)
    return joined.groupBy(*keep).agg(F.sum(F.col("left_value") * F.col("right_value")).alias(value))


def conv1d(signal: DataFrame, weights: DataFrame, taps: int, stride: int = 1, dilation: int = 1, causal: bool = True) -> DataFrame:
    """(signal_id, channel, n, x) through weights (out, channel, tap, w): signal_id, channel, n, x. Zeros outside; causal or centred; ceil(len / stride) outputs.

    Each sample goes to the outputs that its taps reach; weights are few and broadcast.
    """
    if weights.count() > 4_000_000:
        raise ValueError("too many weights to broadcast")
    reach = (taps - 1) * dilation
    left = reach if causal else reach // 2
    size = F.max("n").over(Window.partitionBy("signal_id", "channel")) + 1
    rows = signal.withColumn("len", size).join(F.broadcast(weights), "channel")
    at = F.col("n") + left - F.col("tap") * dilation
    hit = rows.withColumn("at", at).where((F.col("at") >= 0) & (F.col("at") < F.col("len")) & (F.pmod(F.col("at"), F.lit(stride)) == 0))
    return hit.groupBy("signal_id", F.col("out").alias("channel"), F.floor(F.col("at") / stride).alias("n")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))


def gan_losses(scores: DataFrame) -> DataFrame:
    """(id, real, fake) -> id, discriminator, generator: least squares of a discriminator's scores against 1 and 0."""
    return scores.groupBy("id").agg((F.avg(F.pow(1 - F.col("real"), 2)) + F.avg(F.pow("fake", 2))).alias("discriminator"), F.avg(F.pow(1 - F.col("fake"), 2)).alias("generator"))


def feature_loss(features: DataFrame) -> DataFrame:
    """(id, layer, real, fake) -> id, loss: the mean absolute difference of each layer, summed."""
    return features.groupBy("id", "layer").agg(F.avg(F.abs(F.col("real") - F.col("fake"))).alias("l")).groupBy("id").agg(F.sum("l").alias("loss"))
