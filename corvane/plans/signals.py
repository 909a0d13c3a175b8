"""Signal queries over `events` (a signal for each user, whole cents) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import scalar as S
from corvane.operators import resampling as rs
from corvane.operators import signal as sig

SIG = "sig as (select user_id as signal_id, row_number() over (partition by user_id order by ts) - 1 as n, cast(round(value * 100) as bigint) as x from events), len as (select signal_id, count(*) as len from sig group by 1)"
FRAMES = f"{SIG}, fr as (select s.signal_id, f.frame, s.n - f.frame * 4 as i, s.x from sig s join len l using (signal_id) join (select unnest(range(0, 1000)) as frame) f on s.n between f.frame * 4 and f.frame * 4 + 15 and f.frame <= floor((l.len - 16) / 4.0) where l.len >= 16)"

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def events(spark, d):
    return sig.from_events(spark.read.parquet(f"{d}/events.parquet"))


@query(
    "gated_block_energy",
    f"with {FRAMES}, e as (select signal_id, frame, sum(x * x) as e from fr group by 1, 2 having sum(x * x) > 100000), "
    "g as (select *, sum(e) over (partition by signal_id) as s, count(*) over (partition by signal_id) as c from e) "
    "select signal_id, count(*) as blocks, cast(sum(e) as bigint) as energy, round(-0.691 + 10 * log10(sum(e) / (count(*) * 16.0 * 10000.0 * "
    "10000.0)), 6) as loudness from g where e * c * 10 > s group by 1",
)
def gated_block_energy(spark, d):
    out = sig.gated_block_energy(events(spark, d), 16, 4, 100000, 10)
    return out.withColumn("loudness", F.round(-0.691 + 10 * F.log10(F.col("energy") / (F.col("blocks") * 16.0 * 10000.0 * 10000.0)), 6))


@query(
    "frames",
    f"with {FRAMES} select signal_id, frame, cast(sum(x) as bigint) as total, count(*) as size, max(x) - min(x) as range from fr group by 1, 2",
)
def frames(spark, d):
    return sig.frames(events(spark, d), 16, 4).groupBy("signal_id", "frame").agg(F.sum("x").alias("total"), F.count("*").alias("size"), (F.max("x") - F.min("x")).alias("range"))


@query("overlap_add", f"with {FRAMES} select signal_id, frame * 4 + i as n, cast(sum(x) as bigint) as total, count(*) as cover from fr group by 1, 2")
def overlap_add(spark, d):
    return sig.overlap_add(sig.frames(events(spark, d), 16, 4), 4)


@query(
    "triangular_overlap_add",
    f"with {FRAMES} "
    "select signal_id, frame * 4 + i as n, round(sum(x * (0.5 - abs((i + 1) / 17.0::double - 0.5))) / sum(0.5 - abs((i + 1) / 17.0::double - "
    "0.5)), 4) as x from fr group by 1, 2",
)
def triangular_overlap_add(spark, d):
    return sig.triangular_overlap_add(sig.frames(events(spark, d), 16, 4), 16, 4).withColumn("x", F.round("x", 4))


@query(
    "segments",
    f"with {SIG} select s.signal_id, g.k as segment, count(*) as size, cast(sum(x) as bigint) as total from sig s "
    "join (select unnest(range(0, 1000)) as k) g on s.n between g.k * 12 and g.k * 12 + 15 group by 1, 2",
)
def segments(spark, d):
    return sig.segments(events(spark, d), 16, 12).groupBy("signal_id", "segment").agg(F.count("*").alias("size"), F.sum("x").alias("total"))


@query("trim", f"with {SIG} select signal_id, n - 5 as n, x from sig join len using (signal_id) where n >= 5 and n < len - 7")
def trim(spark, d):
    return sig.trim(events(spark, d), 5, 7)


@query(
    "pad_constant",
    f"with {SIG} select signal_id, n + 3 as n, x from sig union all select signal_id, unnest(range(0, 3)), 0 from len union all "
    "select signal_id, len + 3 + unnest(range(0, 5)), 0 from len",
)
def pad_constant(spark, d):
    return sig.pad(events(spark, d), 3, 5)


def _padded(index: str) -> str:
    return f"with {SIG}, p as (select signal_id, len, unnest(range(0, len + 8)) as n from len), q as (select signal_id, n, {index} as k from p) select q.signal_id, q.n, s.x from q join sig s on s.signal_id = q.signal_id and s.n = q.k"


@query("pad_reflect", _padded("case when n < 3 then 3 - n when n >= len + 3 then 2 * (len - 1) - (n - 3) else n - 3 end"))
def pad_reflect(spark, d):
    return sig.pad(events(spark, d), 3, 5, "reflect")


@query("pad_replicate", _padded("least(greatest(n - 3, 0), len - 1)"))
def pad_replicate(spark, d):
    return sig.pad(events(spark, d), 3, 5, "replicate")


@query("pad_circular", _padded("(n - 3 + len) % len"))
def pad_circular(spark, d):
    return sig.pad(events(spark, d), 3, 5, "circular")


@query("pad_to_multiple", f"with {SIG} select signal_id, len, cast(ceil(len / 32.0) * 32 - len as bigint) as extra from len")
def pad_to_multiple(spark, d):
    n = F.col("len")
    return events(spark, d).groupBy("signal_id").agg(F.count("*").alias("len")).withColumn("extra", (F.ceil(n / 32) * 32 - n).cast("long"))


@query("conv_padding", f"with {SIG} select signal_id, len, cast((ceil((len - 7 + 2) / 4.0 + 1) - 1) * 4 + (7 - 2) - len as bigint) as extra from len")
def conv_padding(spark, d):
    n = F.col("len")
    ideal = (F.ceil((n - 7 + 2) / 4 + 1) - 1) * 4 + (7 - 2)
    return events(spark, d).groupBy("signal_id").agg(F.count("*").alias("len")).withColumn("extra", (ideal - n).cast("long"))


@query(
    "preemphasis",
    f"with {SIG} select signal_id, n, round(coalesce(lag(x) over (partition by signal_id order by n), 0) - 0.75::double * x, 2) as x from sig",
)
def preemphasis(spark, d):
    return sig.preemphasis(events(spark, d), 0.75).withColumn("x", F.round("x", 2))


@query("roll", f"with {SIG} select signal_id, (n + 11) % len as n, x from sig join len using (signal_id)")
def roll(spark, d):
    return sig.roll(events(spark, d), 11)


@query(
    "pool_repeat",
    f"with {SIG} select signal_id, n, round(avg(x) over (partition by signal_id, n // 4), 2) as x from sig join len using (signal_id) "
    "where (n // 4 + 1) * 4 <= len",
)
def pool_repeat(spark, d):
    return sig.pool(events(spark, d), 4).withColumn("x", F.round("x", 2))


@query(
    "deinterleave",
    f"with {SIG} select signal_id, cast(n % 2 as int) as channel, n // 2 as n, x from sig join len using (signal_id) where n < len - len % 2",
)
def deinterleave(spark, d):
    return sig.deinterleave(events(spark, d))


@query("interleave_round_trip", f"with {SIG} select signal_id, n, x from sig join len using (signal_id) where n < len - len % 2")
def interleave_round_trip(spark, d):
    return sig.interleave(sig.deinterleave(events(spark, d)))


@query(
    "mono",
    f"with {SIG} select signal_id, n // 2 as n, sum(x) / 2.0::double as x from sig join len using (signal_id) where n < len - len % 2 "
    "group by 1, 2",
)
def mono(spark, d):
    return sig.to_mono(sig.deinterleave(events(spark, d)))


@query(
    "signal_arithmetic",
    f"with {SIG}, c as (select signal_id, n % 2 as ch, n // 2 as n, x from sig join len using (signal_id) where n < len - len % 2) "
    "select a.signal_id, a.n, a.x + b.x as plus, a.x - b.x as minus, a.x * b.x as times from c a join c b using (signal_id, n) "
    "where a.ch = 0 and b.ch = 1",
)
def signal_arithmetic(spark, d):
    c = sig.deinterleave(events(spark, d))
    a, b = c.where("channel = 0").select("signal_id", "n", F.col("x").alias("a")), c.where("channel = 1").select("signal_id", "n", F.col("x").alias("b"))
    return a.join(b, ["signal_id", "n"]).select("signal_id", "n", (F.col("a") + F.col("b")).alias("plus"), (F.col("a") - F.col("b")).alias("minus"), (F.col("a") * F.col("b")).alias("times"))


_TAPS = [0.1, 0.25, 0.3, 0.25, 0.1]


@query("fir", f"with {SIG} select signal_id, n, round(" + " + ".join(f"{t}::double * coalesce(lag(x, {j}) over w, 0)" for j, t in enumerate(_TAPS)) + ", 3) as x from sig window w as (partition by signal_id order by n)")
def fir(spark, d):
    return sig.fir(events(spark, d), _TAPS).withColumn("x", F.round("x", 3))


def _centred(taps):
    return f"with {SIG} select signal_id, n, round(" + " + ".join(f"{t!r}::double * coalesce({'lead' if j < 25 else 'lag'}(x, {abs(j - 25)}) over w, 0)" for j, t in enumerate(taps)) + ", 4) as x from sig window w as (partition by signal_id order by n)"


@query("low_pass", _centred(sig.low_pass_taps(0.1)))
def low_pass(spark, d):
    return sig.fir(events(spark, d), sig.low_pass_taps(0.1), 25).withColumn("x", F.round("x", 4))


@query("high_pass", _centred(sig.high_pass_taps(0.1)))
def high_pass(spark, d):
    return sig.fir(events(spark, d), sig.high_pass_taps(0.1), 25).withColumn("x", F.round("x", 4))


@query(
    "tremolo",
    f"with {SIG} select signal_id, n, round(x * (1 - 0.5 + 0.5 * sin(2 * pi() * 3.0 * (n * 2.0::double / (len - 1)))), 5) as x from sig "
    "join len using (signal_id)",
)
def tremolo(spark, d):
    return sig.tremolo(events(spark, d), 3.0, 0.5, 2.0).withColumn("x", F.round("x", 5))


@query(
    "distortion",
    f"with {SIG} "
    "select signal_id, n, round(0.25 * (x / 50000.0::double) + 0.75 * ((exp(2 * (x / 50000.0::double) * 6.0) - 1) / (exp(2 * (x / "
    "50000.0::double) * 6.0) + 1)), 8) as x from sig",
)
def distortion(spark, d):
    return events(spark, d).select("signal_id", "n", F.round(sig.distortion(F.col("x") / 50000.0, 0.5, 0.75), 8).alias("x"))


def _resampled(pos: str) -> str:
    return f"with {SIG}, o as (select signal_id, len, floor(len * 3 / 2) as m, unnest(range(0, cast(floor(len * 3 / 2) as bigint))) as i from len), p as (select signal_id, i, len, {pos} as pos from o), q as (select *, least(cast(floor(pos) as bigint), len - 1) as k from p) select q.signal_id, q.i as n, round(a.x + (b.x - a.x) * (q.pos - q.k), 4) as x from q join sig a on a.signal_id = q.signal_id and a.n = q.k join sig b on b.signal_id = q.signal_id and b.n = least(q.k + 1, q.len - 1)"


@query("resample_linear", _resampled("i * 2::double / 3::double"))
def resample_linear(spark, d):
    return rs.resample_linear(events(spark, d), 2, 3).withColumn("x", F.round("x", 4))


@query("resample_aligned", _resampled("i * (len - 1)::double / (m - 1)"))
def resample_aligned(spark, d):
    return rs.resample_linear(events(spark, d), 2, 3, True).withColumn("x", F.round("x", 4))


@query(
    "layer_norm",
    f"with {SIG} select signal_id, n, round((x - avg(x) over w) / sqrt(var_pop(x) over w + 0.00001), 7) as x from sig "
    "window w as (partition by signal_id)",
)
def layer_norm(spark, d):
    return sig.layer_norm(events(spark, d)).withColumn("x", F.round("x", 7))


@query(
    "signal_statistics",
    f"with {SIG} select signal_id, count(*) as len, min(x) as lo, max(x) as hi, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std "
    "from sig group by 1",
)
def signal_statistics(spark, d):
    return sig.statistics(events(spark, d)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("rms_scale", f"with {SIG} select signal_id, round(sqrt(sum(x * x) / count(*)::double) + 1e-8, 6) as scale from sig group by 1")
def rms_scale(spark, d):
    return events(spark, d).groupBy("signal_id").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*")) + 1e-8, 6).alias("scale"))


@query(
    "pcm_round_trip",
    f"with {SIG} "
    "select signal_id, n, x / 32768.0::double as f, cast(least(greatest(trunc(x / 32768.0::double * 32767), -32768), 32767) as int) as back "
    "from sig",
)
def pcm_round_trip(spark, d):
    f = S.pcm_to_float(F.col("x"))
    return events(spark, d).select("signal_id", "n", f.alias("f"), S.float_to_pcm16(f).alias("back"))


@query("peak_rescale", f"with {SIG} select signal_id, n, round(x * least(0.99 / max(abs(x)) over (partition by signal_id), 1.0), 5) as x from sig")
def peak_rescale(spark, d):
    gain = F.least(0.99 / F.max(F.abs("x")).over(sig.whole()), F.lit(1.0))
    return events(spark, d).select("signal_id", "n", F.round(F.col("x") * gain, 5).alias("x"))


@query(
    "moving_level",
    "with recursive s as (select user_id as signal_id, row_number() over (partition by user_id order by ts) - 1 as n, cast(round(value * 100) as "
    "bigint) as x from events), r as (select signal_id, n, x, 0.25::double * x as y from s where n = 0 union all "
    "select s.signal_id, s.n, s.x, 0.75::double * r.y + 0.25::double * s.x from r join s on s.signal_id = r.signal_id and s.n = r.n + 1) "
    "select signal_id, round(max_by(y, n), 4) as level, count(*) as len from r group by 1",
)
def moving_level(spark, d):
    """One-pole follower: a fold over each packed signal."""
    packed = sig.pack(events(spark, d))
    y = F.aggregate("x", F.lit(0.0), lambda s, v: F.lit(0.75) * s + F.lit(0.25) * v)
    return packed.select("signal_id", F.round(y, 4).alias("level"), F.size("x").cast("long").alias("len"))
