"""Token operators: byte tokens, delay patterns, logit filters, sampling, quantised distributions, bit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channel delays and sentinels of the nine-channel token grid (fixed values).
DELAYS = (0, 8, 9, 10, 11, 12, 13, 14, 15)
EOS, PAD, BOS = 1024, 1025, 1026


def byte_tokens(text: Column, tags: dict[str, int] | None = None, limit: int = 1024) -> Column:
    """Hexadecimal UTF-8 bytes of text, tags replaced by single bytes, cut to limit bytes."""
    for tag, byte in (tags or {"[S1]": 1, "[S2]": 2}).items():
        text = F.replace(text, F.lit(tag), F.lit(chr(byte)))
    return F.substring(F.hex(F.encode(text, "UTF-8")), 1, 2 * limit)


def byte_array(hex_bytes: Column, length: int) -> Column:
    """Hexadecimal bytes as array<int>, cut to length or padded with 0 to it; null as none."""
    # a Latin-1 character's code is its byte; no text splits into one empty character, whose code is 0 too
    chars = F.split(F.decode(F.unhex(F.substring(F.coalesce(hex_bytes, F.lit("")), 1, 2 * length)), "ISO-8859-1"), "")
    values = F.transform(chars, lambda c: F.ascii(c))
    # each value is bound to a variable before it is used twice, and hex_bytes stands outside of every lambda: it is evaluated once a row
    return F.element_at(F.transform(F.array(values), lambda v: F.concat(v, F.array_repeat(F.lit(0), F.lit(length) - F.size(v)))), 1)


def _delay(channel: Column, delays) -> Column:
    return F.get(F.array(*[F.lit(d) for d in delays]), channel)


def apply_delay(grid: DataFrame, delays=DELAYS, bos: int = BOS, keys=("b",)) -> DataFrame:
    """grid (b, t, c, token), t gapless from 0: channel c is read delays[c] steps late, BOS before the start."""
    w = Window.partitionBy(*keys, "c").orderBy("t")
    token = F.lit(None).cast("int")
    for c, d in enumerate(delays):
        token = F.when(F.col("c") == c, F.lag("token", d).over(w) if d else F.col("token")).otherwise(token)
    return grid.select(*keys, "t", "c", F.coalesce(token, F.lit(bos)).alias("token"))


def revert_delay(grid: DataFrame, delays=DELAYS, keys=("b",)) -> DataFrame:
    """Reads min(t + delays[c], last) of each channel."""
    w = Window.partitionBy(*keys, "c").orderBy("t")
    last = F.last("token").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    token = F.lit(None).cast("int")
    for c, d in enumerate(delays):
        token = F.when(F.col("c") == c, F.lead("token", d).over(w) if d else F.col("token")).otherwise(token)
    return grid.select(*keys, "t", "c", F.coalesce(token, last).alias("token"))


def end_countdown(grid: DataFrame, delays=DELAYS, eos: int = EOS, pad: int = PAD, keys=("b",)) -> DataFrame:
    """After the first EOS of channel 0 at step t0, channel c has EOS at t0 + delays[c] and PAD behind it."""
    first = F.min(F.when((F.col("c") == 0) & (F.col("token") == eos), F.col("t"))).over(Window.partitionBy(*keys))
    step = F.col("t") - first - _delay(F.col("c"), delays)
    return grid.select(*keys, "t", "c", F.when(step == 0, eos).when(step > 0, pad).otherwise(F.col("token")).alias("token"))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """logits (row, token, weight): the k largest of each row, ties to the lower token; rank from 1."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("weight").desc(), "token"))
    return logits.withColumn("rank", rank).where(F.col("rank") <= k)


def top_p(ranked: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Nucleus of ranked whole weights: a token stays while those before it hold at most numerator / denominator of the row."""
    w = Window.partitionBy("row").orderBy("rank")
    before = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("weight").over(Window.partitionBy("row"))
    return ranked.withColumns({"before": before, "total": total}).where(F.col("before") * denominator <= F.col("total") * numerator)


def draw(ranked: DataFrame, uniform: Column) -> DataFrame:
    """One token of each row: the first whose running share reaches uniform(row) in [0, 1)."""
    w = Window.partitionBy("row").orderBy("rank")
    running = ranked.withColumns({"run": F.sum("weight").over(w), "all": F.sum("weight").over(Window.partitionBy("row"))})
    return running.where(F.col("run") > uniform * F.col("all")).groupBy("row").agg(F.min_by("token", "rank").alias("token"))


def hashed_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def quantized_cdf(counts: DataFrame, bits: int = 12, least: int = 2) -> DataFrame:
    """counts (symbol, n) -> symbol, width, low, high: whole ranges of a distribution scaled to 2^bits less the least widths. More symbols than have room, or a negative count, fail the query."""
    if least < 1 or not 0 < bits <= 30:
        raise ValueError("least must be positive and bits from 1 to 30")
    all_ = counts.agg(F.sum("n").alias("total"), F.count("*").alias("symbols"))
    scale = F.lit(1 << bits) - F.col("symbols") * least
    width = F.expr(f"n * ({1 << bits} - symbols * {least}) div total + {least}")
    w = Window.orderBy("symbol")  # a row for each symbol of the alphabet
    fits = (scale > 0) & (F.col("total") > 0) & (F.col("n") >= 0)
    out = counts.join(F.broadcast(all_)).select("symbol", F.when(fits, width).otherwise(F.raise_error(F.lit("the symbols don't fit the range")).cast("bigint")).alias("width"))
    high = F.sum("width").over(w)
    return out.select("symbol", "width", (high - F.col("width")).alias("low"), high.alias("high"))


def pack_bits(codes: DataFrame, bits: int) -> DataFrame:
    """codes (stream, pos, code), pos gapless from 0 -> (stream, byte, value), least significant bit first, the last byte part full."""
    each = codes.select("stream", "pos", "code", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
    at = F.col("pos") * bits + F.col("k")
    bit = F.expr("shiftright(code, k)").bitwiseAND(1)
    return each.select("stream", F.floor(at / 8).alias("byte"), (bit * F.expr(f"shiftleft(1, cast((pos * {bits} + k) % 8 as int))")).alias("v")).groupBy("stream", "byte").agg(F.sum("v").cast("int").alias("value"))


def unpack_bits(packed: DataFrame, bits: int) -> DataFrame:
    """The inverse of pack_bits; codes that lack bits at the end are dropped."""
    each = packed.select("stream", "byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    each = each.withColumn("at", F.col("byte") * 8 + F.col("k")).withColumn("pos", F.floor(F.col("at") / bits))
    bit = F.expr("shiftright(value, k)").bitwiseAND(1) * F.expr(f"shiftleft(1, cast(at - pos * {bits} as int))")
    return each.groupBy("stream", "pos").agg(F.sum(bit).cast("int").alias("code"), F.count("*").alias("n")).where(F.col("n") == bits).drop("n")


def fill_grid(grid: DataFrame, new: DataFrame, only_open: bool = True, open_token: int = -1, keys=("b",)) -> DataFrame:
    """grid (b, t, c, token) with the tokens of new written in; with only_open where the grid still has open_token."""
    joined = grid.join(new.withColumnRenamed("token", "fresh"), [*keys, "t", "c"], "left")
    take = F.col("fresh").isNotNull() & ((F.col("token") == open_token) if only_open else F.lit(True))
    return joined.withColumn("token", F.when(take, F.col("fresh")).otherwise(F.col("token"))).select(*keys, "t", "c", "token")


def open_grid(spark, batch: int, steps: int, channels: int, open_token: int = -1) -> DataFrame:
    """b, t, c, token: a grid of open_token."""
    cell = F.col("id")
    return spark.range(batch * steps * channels).select(F.floor(cell / (steps * channels)).alias("b"), F.floor(F.pmod(cell, F.lit(steps * channels)) / channels).alias("t"), F.pmod(cell, F.lit(channels)).cast("int").alias("c"), F.lit(open_token).alias("token"))


def choose(options: DataFrame, key: Column, groups: str = "grp") -> DataFrame:
    """One row for each key (grp, weight, item): a group by its weight, then an item of it evenly, by two hashed numbers of key.

    options has (key, grp, weight, item); the weights of a group's rows are equal.
    """
    one = options.groupBy("key", groups).agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list("item")).alias("items"))
    w = Window.partitionBy("key").orderBy(groups)
    ran = one.withColumns({"run": F.sum("weight").over(w), "all": F.sum("weight").over(Window.partitionBy("key"))}).withColumn("u", hashed_uniform(F.concat_ws(":", key.cast("string"), F.lit("group"))))
    hit = ran.where(F.col("run") > F.col("u") * F.col("all")).groupBy("key").agg(F.min_by(F.struct(groups, "items"), groups).alias("g"))
    index = F.floor(hashed_uniform(F.concat_ws(":", key.cast("string"), F.lit("item"))) * F.size("g.items")).cast("int")
    return hit.select("key", F.col(f"g.{groups}").alias(groups), F.get("g.items", index).alias("item"))


def sample_distribution(key: Column, kind: str, *parameters: float) -> Column:
    """A number drawn for key: const(value), uniform(low, high) or normal(mean, std), from hashed numbers (Box-Muller)."""
    u = lambda name: hashed_uniform(F.concat_ws(":", key.cast("string"), F.lit(name)))
    if kind == "const":
        return F.lit(float(parameters[0]))
    if kind == "uniform":
        low, high = parameters
        return low + (high - low) * u("u")
    if kind == "normal":
        mean, std = parameters
        return mean + std * F.sqrt(-2 * F.log(1 - u("a"))) * F.cos(2 * F.pi() * u("b"))
    raise ValueError(f"unknown distribution: {kind}")
