"""Spectra, loudness, effects and resampling over `events` (a signal for each user) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import effects as fx
from corvane.operators import loudness as loud
from corvane.operators import resampling as rs
from corvane.operators import signal as sig
from corvane.operators import spectra as spx
from corvane.operators.vectors import mel_weights
from corvane.plans.signals import SIG, events

QUERIES, ORACLES = {}, {}
#: The signals' rate, their scale, and the window and hop of the spectral queries.
RATE, SCALE, WINDOW, HOP, MELS = 40, 50000.0, 16, 4, 4
BINS = WINDOW // 2 + 1


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def packed(spark, d):
    """Signals between -1 and 1 as arrays."""
    return sig.pack(events(spark, d).select("signal_id", "n", (F.col("x") / SCALE).alias("x")))


def unpacked(rows, digits: int):
    # adding zero turns a rounded -0.0 into 0.0
    return sig.unpack(rows).select("signal_id", "n", (F.round("x", digits) + 0.0).alias("x"))


XS = f"{SIG}, xs as (select signal_id, n, x / {SCALE}::double as x from sig)"
# samples by padded place: reflected half a window, short signals extended by zeros first
PADDED = f"""{XS}, size as (select signal_id, len, greatest(len, {WINDOW // 2 + 1}) as elen from len),
places as (select signal_id, len, elen, unnest(range(0, elen + {WINDOW})) as p from size),
idx as (select *, case when p - {WINDOW // 2} < 0 then {WINDOW // 2} - p when p - {WINDOW // 2} >= elen then 2 * (elen - 1) - (p - {WINDOW // 2}) else p - {WINDOW // 2} end as i from places),
pad as (select idx.signal_id, idx.p, idx.elen, coalesce(xs.x, 0) as x from idx left join xs on xs.signal_id = idx.signal_id and xs.n = idx.i),
framed as (select signal_id, f.frame, p - f.frame * {HOP} as j, x * (0.5 - 0.5 * cos(2 * pi() * (p - f.frame * {HOP}) / {WINDOW}.0::double)) as y from pad join (select unnest(range(0, 2000)) as frame) f on p >= f.frame * {HOP} and p < f.frame * {HOP} + {WINDOW} and f.frame <= elen // {HOP}),
spec as (select signal_id, frame, cast(k as int) as bin, sum(y * cos(2 * pi() * k * j / {WINDOW}.0::double)) as re, -sum(y * sin(2 * pi() * k * j / {WINDOW}.0::double)) as im from framed, (select unnest(range(0, {BINS})) as k) group by 1, 2, 3)"""
_MEL_SQL = ", ".join(f"({m}, {k}, {w!r}::double)" for m, k, w in mel_weights(MELS, BINS, RATE))
MEL = f"{PADDED}, w(mel, bin, w) as (values {_MEL_SQL}), mel as (select signal_id, frame, mel, sum(sqrt(re * re + im * im) * w) as value from spec join w using (bin) group by 1, 2, 3)"


def spectrum(spark, d):
    return spx.stft(packed(spark, d), WINDOW, HOP)


def shifted(spark, d):
    """The signals, each under the number before its own."""
    return packed(spark, d).select((F.col("signal_id") - 1).alias("signal_id"), "x")


@query("stft", f"with {PADDED} select signal_id, frame, bin, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from spec")
def stft(spark, d):
    return spectrum(spark, d).select("signal_id", "frame", "bin", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query("istft_round_trip", f"with {XS} select signal_id, n, round(x, 6) + 0.0 as x from xs")
def istft_round_trip(spark, d):
    rows = packed(spark, d)
    return unpacked(spx.istft(spectrum(spark, d), rows.select("signal_id", F.size("x").alias("len")), WINDOW, HOP), 6)


@query("stft_match_stride", f"with {XS} select signal_id, cast(ceil(len / {HOP}.0) as bigint) as frames from len")
def stft_match_stride(spark, d):
    """Frames with padding to whole hops: one for each hop."""
    return spx.stft(packed(spark, d), WINDOW, HOP, match_stride=True).groupBy("signal_id").agg((F.max("frame") + 1).alias("frames"))


@query(
    "magnitude_phase",
    f"with {PADDED} "
    "select signal_id, frame, bin, round(sqrt(re * re + im * im), 6) as magnitude, round(cos(atan2(im, re)), 4) + 0.0 as c, round(sin(atan2(im, "
    "re)), 4) + 0.0 as s from spec where sqrt(re * re + im * im) > 0.01",
)
def magnitude_phase(spark, d):
    rows = spx.magnitude_phase(spectrum(spark, d)).where("magnitude > 0.01")
    return rows.select("signal_id", "frame", "bin", F.round("magnitude", 6).alias("magnitude"), (F.round(F.cos("phase"), 4) + 0.0).alias("c"), (F.round(F.sin("phase"), 4) + 0.0).alias("s"))


@query("polar_round_trip", f"with {PADDED} select signal_id, frame, bin, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from spec")
def polar_round_trip(spark, d):
    rows = spx.from_magnitude_phase(spx.magnitude_phase(spectrum(spark, d)))
    return rows.select("signal_id", "frame", "bin", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query(
    "stft_log_magnitude",
    f"with {PADDED}, l as (select *, 10 * log10(greatest(re * re + im * im, 1e-6)) - 10 * log10(0.5::double) as db from spec) "
    "select signal_id, frame, bin, round(greatest(db, max(db) over (partition by signal_id) - 30), 4) as db from l",
)
def stft_log_magnitude(spark, d):
    return spx.log_magnitude(spectrum(spark, d), ref=0.5, amin=1e-3, top_db=30.0).withColumn("db", F.round("db", 4))


@query(
    "mask_bins",
    f"with {PADDED} "
    f"select signal_id, frame, bin, round(case when bin * {RATE / 2} / {BINS - 1} >= 5 and bin * {RATE / 2} / {BINS - 1} < 10 then 0 else sqrt(re "
    "* re + im * im) end, 6) as magnitude from spec",
)
def mask_bins(spark, d):
    rows = spx.mask_frequencies(spectrum(spark, d), 5.0, 10.0, RATE, BINS)
    return rows.select("signal_id", "frame", "bin", F.round(F.hypot("re", "im"), 6).alias("magnitude"))


@query(
    "mask_timesteps",
    f"with {PADDED}, t as (select spec.*, frame * (len / {RATE}.0::double) / greatest(max(frame) over (partition by signal_id), 1) as t from spec "
    "join len using (signal_id)) "
    "select signal_id, frame, bin, round(case when t >= 0.25 and t < 0.75 then 0 else sqrt(re * re + im * im) end, 6) as magnitude from t",
)
def mask_timesteps(spark, d):
    size = packed(spark, d).select("signal_id", (F.size("x") / float(RATE)).alias("duration"))
    rows = spx.mask_timesteps(spectrum(spark, d).join(size, "signal_id"), 0.25, 0.75, RATE)
    return rows.select("signal_id", "frame", "bin", F.round(F.hypot("re", "im"), 6).alias("magnitude"))


@query("signal_mel", f"with {MEL} select signal_id, frame, mel, round(value, 6) as value from mel")
def signal_mel(spark, d):
    return spx.mel(spectrum(spark, d), MELS, BINS, RATE).withColumn("value", F.round("value", 6))


@query(
    "compare_spectrograms",
    f"with {MEL} select a.signal_id, a.frame, a.mel, round(abs(a.value - b.value), 5) as difference from mel a "
    "join mel b on b.signal_id = a.signal_id + 1 and b.frame = a.frame and b.mel = a.mel",
)
def compare_spectrograms(spark, d):
    a, b = (spx.mel(spx.stft(x, WINDOW, HOP), MELS, BINS, RATE) for x in (packed(spark, d), shifted(spark, d)))
    return spx.compare_spectrograms(a, b).withColumn("difference", F.round("difference", 5))


@query(
    "mel_loss",
    f"with {MEL}, p as (select a.signal_id, a.value as x, b.value as y from mel a "
    "join mel b on b.signal_id = a.signal_id + 1 and b.frame = a.frame and b.mel = a.mel) "
    "select signal_id, round(avg(abs(log10(pow(greatest(x, 0.001), 2)) - log10(pow(greatest(y, 0.001), 2)))) + avg(abs(x - y)), 5) as loss "
    "from p group by 1",
)
def mel_loss(spark, d):
    return spx.mel_loss(packed(spark, d), shifted(spark, d), RATE, (WINDOW,), (MELS,), floor=1e-3).withColumn("loss", F.round("loss", 5))


@query("multi_scale_mel_loss")
def multi_scale_mel_loss(spark, d):
    return spx.mel_loss(packed(spark, d), shifted(spark, d), RATE, (32, 16, 8), (6, 4, 2), floor=1e-3).withColumn("loss", F.round("loss", 4))


@query(
    "spectrogram_image",
    f"with {PADDED}, m as (select signal_id, frame, bin, round(sqrt(re * re + im * im), 6) as v from spec), "
    "r as (select *, min(v) over w as lo, max(v) over w as hi from m window w as (partition by signal_id)) "
    f"select signal_id, frame as x, {BINS - 1} - bin as y, cast(case when hi > lo then floor((v - lo) / (hi - lo) * 255) else 0 end as int) as "
    "shade from r",
)
def spectrogram_image(spark, d):
    rows = spectrum(spark, d).select("signal_id", "frame", "bin", F.round(F.hypot("re", "im"), 6).alias("v"))
    return spx.byte_grid(rows, "frame", "bin", "v")


# two biquads in a row, a step for each sample: x1, x2 and y1, y2 of both
_A, _B = fx.K_WEIGHTING[0], fx.K_WEIGHTING[1]


def _section(b, a, x, x1, x2, y1, y2):
    return f"{b[0]!r}::double * {x} + {b[1]!r}::double * {x1} + {b[2]!r}::double * {x2} - {a[1]!r}::double * {y1} - {a[2]!r}::double * {y2}"


_FIRST = _section(*_A, "xs.x", "r.x", "r.x1", "r.u", "r.u1")
KW = f"""with recursive {XS}, r as (select signal_id, n, x, 0.0::double as x1, {_A[0][0]!r}::double * x as u, 0.0::double as u1, {_B[0][0]!r}::double * {_A[0][0]!r}::double * x as y, 0.0::double as y1 from xs where n = 0
union all select xs.signal_id, xs.n, xs.x, r.x, {_FIRST}, r.u, {_section(*_B, f"({_FIRST})", "r.u", "r.u1", "r.y", "r.y1")}, r.y from r join xs on xs.signal_id = r.signal_id and xs.n = r.n + 1)"""
_BLOCK, _STEP = 16, 4
LOUD = f"""{KW}, blocks as (select r.signal_id, f.frame, sum(y * y) / {_BLOCK} as g from r join len using (signal_id) join (select unnest(range(0, 2000)) as frame) f on r.n >= f.frame * {_STEP} and r.n < f.frame * {_STEP} + {_BLOCK} and f.frame <= floor((len - {_BLOCK}) / {_STEP}.0) where len >= {_BLOCK} group by 1, 2),
loud as (select *, -0.691 + 10 * log10(g) as l from blocks where g > 0), a as (select *, -0.691 + 10 * log10(avg(g) over (partition by signal_id)) - 10 as gate from loud where l > -70),
res as (select signal_id, count(*) as blocks, -0.691 + 10 * log10(avg(g)) as loudness from a where l > gate group by 1)"""


def mono(spark, d):
    return events(spark, d).select("signal_id", F.lit(0).alias("channel"), "n", (F.col("x") / SCALE).alias("x"))


@query("k_weighting", f"{KW} select signal_id, n, round(y, 5) + 0.0 as x from r")
def k_weighting(spark, d):
    return unpacked(fx.k_weighting(packed(spark, d)), 5)


@query(
    "integrated_loudness",
    f"{LOUD} select l.signal_id, coalesce(res.blocks, 0) as blocks, round(res.loudness, 4) as loudness from len l left join res using (signal_id)",
)
def integrated_loudness(spark, d):
    return loud.integrated(mono(spark, d), RATE).withColumn("loudness", F.round("loudness", 4))


@query("stereo_loudness")
def stereo_loudness(spark, d):
    rows = sig.deinterleave(events(spark, d)).withColumn("x", F.col("x") / SCALE)
    return loud.loudness(rows, RATE).withColumn("loudness", F.round("loudness", 4))


@query(
    "loudness_normalize",
    f"{LOUD}, f as (select signal_id, greatest(coalesce(res.loudness, -70), -70) as l from len left join res using (signal_id) where len >= 20) "
    "select signal_id, n, round(x * exp((-24 - l) * 0.1151292546497023), 5) + 0.0 as x from xs join f using (signal_id)",
)
def loudness_normalize(spark, d):
    """Signals of half a second and more (shorter ones are measured with zeros behind them, which the SQL leaves out)."""
    rows = sig.length(mono(spark, d)).where(f"len >= {int(0.5 * RATE)}").drop("len")
    out = loud.normalize(rows, -24.0, RATE)
    return out.select("signal_id", "n", (F.round("x", 5) + 0.0).alias("x"))


@query(
    "excerpt",
    f"with {SIG}, "
    "s as (select signal_id, len, cast(floor(cast('0x' || substr(md5(signal_id::varchar || ':7'), 1, 8) as bigint) / 4294967296.0::double * "
    "greatest(len - 20 + 1, 1)) as bigint) as start from len) select signal_id, n - start as n, x from sig join s using (signal_id) "
    "where n >= start and n < start + 20",
)
def excerpt(spark, d):
    return loud.excerpt(events(spark, d), 20, 7)


@query("salient_excerpt")
def salient_excerpt(spark, d):
    out = loud.salient_excerpt(mono(spark, d), 20, 7, RATE, cutoff=-10.0, tries=4)
    return out.select("signal_id", "try", "n", F.round("x", 6).alias("x"))


@query(
    "chorus",
    f"with {XS}, l as (select xs.signal_id, n, x, len, n * (len / {RATE}.0::double / greatest(len - 1, 1)) as t from xs "
    "join len using (signal_id)), v as (select *, unnest([0, 1]) as v from l), "
    f"dl as (select *, cast(floor((0.5::double + 0.005::double * v + 0.002::double + 0.003::double * v / 2) * {RATE}) as bigint) as most, "
    "(0.5::double + 0.2::double * (v - 1) / 2) as rate from v), "
    "p as (select *, most * 0.5::double * (1 + sin(2 * pi() * rate * t + v * pi() / 2)) as delay from dl), "
    "q as (select *, cast(floor(delay) as bigint) as k, delay - floor(delay) as part from p) "
    "select q.signal_id, q.n, round(0.5 * max(q.x) + 0.5 * sum((1 - part) * coalesce(a.x, 0) + part * case when k + 1 <= most then coalesce(b.x, "
    "0) else 0 end) / 2, 5) + 0.0 as x from q left join xs a on a.signal_id = q.signal_id and a.n = q.n - 1 - k left "
    "join xs b on b.signal_id = q.signal_id and b.n = q.n - 2 - k group by 1, 2",
)
def chorus(spark, d):
    return unpacked(fx.chorus(packed(spark, d), voices=2, base_delay=0.5, sample_rate=RATE), 5)


_ATTACK, _RELEASE = "(1 - exp(-1 / 2.0::double))", "(1 - exp(-1 / 8.0::double))"
_LEVEL = f"r.level + case when abs(xs.x) > r.level then {_ATTACK} else {_RELEASE} end * (abs(xs.x) - r.level)"


@query(
    "compressor",
    f"with recursive {XS}, r as (select signal_id, n, x, abs(x) * {_ATTACK} as level from xs where n = 0 union all "
    f"select xs.signal_id, xs.n, xs.x, {_LEVEL} from r join xs on xs.signal_id = r.signal_id and xs.n = r.n + 1) "
    "select signal_id, n, round(x * pow(10, 6 / 20.0::double) * case when level > pow(10, -20 / 20.0::double) then pow(level / pow(10, -20 / "
    "20.0::double), 1 / 4.0::double - 1) else 1 end, 6) + 0.0 as x from r",
)
def compressor(spark, d):
    return unpacked(fx.compressor(packed(spark, d), -20.0, 4.0, 0.05, 0.2, 6.0, RATE), 6)


@query("flanger")
def flanger(spark, d):
    return unpacked(fx.flanger(packed(spark, d), 0.5, 0.2, 0.7, 0.7, RATE), 6)


@query("phaser")
def phaser(spark, d):
    return unpacked(fx.phaser(packed(spark, d), sample_rate=RATE, low=2.0, high=16.0), 6)


@query("reverb")
def reverb(spark, d):
    """Delays cut to the signals' length; what is tested is in tests/test_effects.py."""
    return unpacked(fx.reverb(packed(spark, d), combs=(15, 16, 14, 13), all_passes=(5, 4)), 6)


@query("pitch_shift")
def pitch_shift(spark, d):
    return unpacked(fx.pitch_shift(packed(spark, d), 5.0, WINDOW), 4)


@query(
    "iir",
    f"with recursive {XS}, r as (select signal_id, n, x, 0.0::double as x1, 0.2137::double * x as y, 0.0::double as y1 from xs where n = 0 "
    "union all "
    "select xs.signal_id, xs.n, xs.x, r.x, 0.2137::double * xs.x + 0.31::double * r.x + 0.17::double * r.x1 + 0.53::double * r.y - "
    "0.2139::double * r.y1, r.y from r join xs on xs.signal_id = r.signal_id and xs.n = r.n + 1) select signal_id, n, round(y, 8) + 0.0 as x "
    "from r",
)
def iir(spark, d):
    return unpacked(fx.iir(packed(spark, d), (0.2137, 0.31, 0.17), (1.0, -0.53, 0.2139)), 8)


@query(
    "feedback_delay",
    f"with {SIG} "
    "select s.signal_id, s.n, round(0.5::double * max(s.x) + 0.5::double * coalesce(sum(pow(0.5::double, (s.n - m.n) / 7 - 1) * m.x), 0), 4) as "
    "x from sig s left join sig m on m.signal_id = s.signal_id and m.n < s.n and (s.n - m.n) % 7 = 0 group by 1, 2",
)
def feedback_delay(spark, d):
    return sig.unpack(fx.feedback_delay(sig.pack(events(spark, d)).select("signal_id", F.col("x").cast("array<double>").alias("x")), 7, 0.5, 0.5, 0.5)).withColumn("x", F.round("x", 4))


_TAPS = rs.sinc_taps(3, 2)


@query(
    "resample_rational",
    f"with {SIG}, h as (select unnest(range(0, 129)) as j, unnest([{', '.join(repr(t) for t in _TAPS)}]::double[]) as w), "
    "o as (select signal_id, unnest(range(0, cast(ceil(len * 3 / 2.0) as bigint))) as m from len) "
    "select o.signal_id, o.m as n, round(sum(s.x * h.w), 3) + 0.0 as x from o "
    "join sig s on s.signal_id = o.signal_id and abs(s.n * 3 - o.m * 2) <= 64 join h on h.j = o.m * 2 - s.n * 3 + 64 group by 1, 2",
)
def resample_rational(spark, d):
    return rs.resample_rational(events(spark, d), 3, 2, _TAPS).select("signal_id", "n", (F.round("x", 3) + 0.0).alias("x"))


@query(
    "interpolate_asof",
    f"with {SIG}, g as (select signal_id, n * n as xp, x as fp, lead(n * n) over w as xn, lead(x) over w as fn from sig "
    "window w as (partition by signal_id order by n)), a as (select signal_id, n * 7 - 3 as at from sig) "
    "select a.signal_id, cast(a.at as double) as at, round(case when a.at < 0 then (select fp from g z "
    "where z.signal_id = a.signal_id and z.xp = 0) when g.xn is null then g.fp else g.fp + (g.fn - g.fp) * ((a.at - g.xp) / (g.xn - "
    "g.xp)::double) end, 4) as y from a left join g on g.signal_id = a.signal_id and a.at >= g.xp and (g.xn is null or a.at < g.xn)",
)
def interpolate_asof(spark, d):
    """Points at squares, asked for at other places, some of them beyond both ends."""
    rows = events(spark, d)
    points = rows.select("signal_id", (F.col("n") * F.col("n")).alias("xp"), F.col("x").alias("fp"))
    return rs.interpolate(points, rows.select("signal_id", (F.col("n") * 7 - 3).alias("at"))).withColumn("y", F.round("y", 4))


@query(
    "adjust_speed",
    f"with {SIG}, "
    "o as (select signal_id, len, cast(floor(len / 0.8::double) as bigint) as m, unnest(range(0, cast(floor(len / 0.8::double) as bigint))) as i "
    "from len), p as (select *, case when m > 1 then i * (len - 1) / (m - 1)::double else 0 end as pos from o), "
    "q as (select *, least(cast(floor(pos) as bigint), len - 1) as k from p) "
    "select q.signal_id, q.i as n, round(a.x + (b.x - a.x) * (q.pos - q.k), 3) as x from q join sig a on a.signal_id = q.signal_id and a.n = q.k "
    "join sig b on b.signal_id = q.signal_id and b.n = least(q.k + 1, q.len - 1)",
)
def adjust_speed(spark, d):
    return rs.adjust_speed(events(spark, d), 0.8).withColumn("x", F.round("x", 3))


@query(
    "waveforms",
    "select i as n, round(sin(2 * pi() * p), 6) + 0.0 as sine, cast(sign(round(sin(2 * pi() * p), 9)) as int) as square, round(2 * (p - floor(p "
    "+ 0.5)), 6) + 0.0 as sawtooth, round(2 * abs(2 * (p - floor(p + 0.5))) - 1, 6) + 0.0 as triangle, 0.0::double as zeros "
    "from (select i, 5.3::double * (i * 1.0::double / 999) as p from range(0, 1000) t(i))",
)
def waveforms(spark, d):
    shapes = [sig.wave(spark, s, 5.3, 1.0, 1000).withColumnRenamed("x", s) for s in ("sine", "square", "sawtooth", "triangle")]
    rows = sig.zeros(spark, 1000).withColumnRenamed("x", "zeros")
    for s in shapes:
        rows = rows.join(s.drop("signal_id"), "n")
    return rows.select("n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sine", "sawtooth", "triangle")], F.signum(F.round("sine", 9)).cast("int").alias("square"), "zeros")


@query(
    "batch_padded",
    f"with {SIG}, m as (select max(len) as most from len), p as (select signal_id, unnest(range(0, most)) as n from len, m) "
    "select p.signal_id, p.n, coalesce(s.x, 0) as x from p left join sig s using (signal_id, n)",
)
def batch_padded(spark, d):
    return sig.batch(events(spark, d), "pad")


@query("batch_truncated", f"with {SIG} select signal_id, n, x from sig where n < (select min(len) from len)")
def batch_truncated(spark, d):
    return sig.batch(events(spark, d), "truncate")


@query(
    "nearest_bin",
    "with b as (select event_id, value as hz from events) "
    "select event_id, cast(least(greatest(ceil(hz / (1000 / 64.0::double) - 0.5), 0), 32) as bigint) as bin from b",
)
def nearest_bin(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", rs.hz_to_bin(F.col("value"), 64, 1000.0).alias("bin"))
