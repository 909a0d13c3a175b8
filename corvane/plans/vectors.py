"""Vector queries over `embeddings` (scaled to whole numbers) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import attention as att
from corvane.operators import vectors as vec

QUERIES, ORACLES = {}, {}
#: Whole numbers of 1e-4: products and sums are exact in 64 bits.
E = "e as (select vec_id as id, unnest(range(0, 64)) as d, cast(round(unnest(embedding)::double * 10000) as bigint) as v from embeddings)"
BOOK = "b as (select id as code, d, v from e where id < 16)"
NEAR = f"{E}, {BOOK}, dist as (select e.id, b.code, sum((e.v - b.v) * (e.v - b.v)) as s from e join b using (d) group by 1, 2), near as (select id, arg_min(code, (s, code)) as code, min(s) as dist from dist group by 1)"


def checksum():
    """A number that depends on every place of `vec`."""
    return F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def whole(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long")).alias("vec"), "label")


def book(rows, low, high):
    return rows.where((F.col("id") >= low) & (F.col("id") < high)).select((F.col("id") - low).alias("code"), "vec")


@query("nearest_code", f"with {NEAR} select id, code, cast(dist as bigint) as dist from near")
def nearest_code(spark, d):
    rows = whole(spark, d)
    return vec.nearest(rows, book(rows, 0, 16)).select("id", "code", "dist")


@query(
    "code_histogram",
    f"with {NEAR}, k as (select unnest(range(0, 16)) as code) "
    "select k.code, count(near.id) as n, round(coalesce(-count(near.id) / 1.0 / (select count(*) "
    "from near) * log2(nullif(count(near.id), 0) / 1.0 / (select count(*) from near)), 0), 9) as bits from k left join near using (code) "
    "group by 1",
)
def code_histogram(spark, d):
    rows = whole(spark, d)
    hits = vec.nearest(rows, book(rows, 0, 16)).groupBy("code").agg(F.count("*").alias("n"))
    all_ = rows.agg(F.count("*").alias("all"))
    p = F.col("n") / F.col("all")
    return spark.range(16).select(F.col("id").alias("code")).join(hits, "code", "left").fillna(0, ["n"]).join(F.broadcast(all_)).select("code", "n", F.round(F.when(F.col("n") == 0, 0.0).otherwise(-p * F.log2(p)), 9).alias("bits"))


@query(
    "residual_quantize",
    f"with {NEAR}, r as (select e.id, e.d, e.v - b.v as v from e join near using (id) join b on b.code = near.code and b.d = e.d), "
    "b2 as (select id - 16 as code, d, v from e where id >= 16 and id < 32), "
    "dist2 as (select r.id, b2.code, sum((r.v - b2.v) * (r.v - b2.v)) as s from r join b2 using (d) group by 1, 2), "
    "n2 as (select id, arg_min(code, (s, code)) as code, min(s) as dist from dist2 group by 1) "
    "select near.id, near.code as code1, n2.code as code2, cast(n2.dist as bigint) as error from near join n2 using (id)",
)
def residual_quantize(spark, d):
    rows = whole(spark, d)
    out = vec.residual_quantize(rows, [book(rows, 0, 16), book(rows, 16, 32)])
    return out.select("id", F.get("codes", F.lit(0)).alias("code1"), F.get("codes", F.lit(1)).alias("code2"), F.aggregate("residual", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("error"))


@query("dequantize", f"with {NEAR} select near.id, cast(sum(b.v * (b.d + 1)) as bigint) as checksum from near join b using (code) group by 1")
def dequantize(spark, d):
    rows = whole(spark, d)
    code = book(rows, 0, 16)
    coded = vec.nearest(rows, code).select("id", F.array(F.col("code").cast("long")).alias("codes"))
    return vec.dequantize(coded, [code]).select("id", F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


@query(
    "quantization_error",
    f"with {NEAR}, x as (select e.id, e.v as r, b.v as q from e join near using (id) join b on b.code = near.code and b.d = e.d), "
    "s as (select id, sum(r * r) as rr, sum(q * r) as qr, sum(q * q) as qq, sum(abs(r - q)) as l1, sum((r - q) * (r - q)) as l2 from x "
    "group by 1) "
    "select id, cast(l1 as bigint) as l1, round(l2 / 64.0::double / 1e8::double, 9) as mse, round(case when qq * rr = qr * qr then 99 else 10 * "
    "log10((qr::double * qr::double / rr) / (qq - qr::double * qr::double / rr)) end, 4) as si_sdr from s",
)
def quantization_error(spark, d):
    rows = whole(spark, d)
    hit = vec.nearest(rows, book(rows, 0, 16)).select("id", F.arrays_zip("vec", "residual").alias("z"))
    total = lambda f: F.aggregate("z", F.lit(0).cast("long"), lambda s, z: s + f(z["vec"], z["vec"] - z["residual"]))
    s = hit.select("id", total(lambda r, q: r * r).alias("rr"), total(lambda r, q: q * r).alias("qr"), total(lambda r, q: q * q).alias("qq"), total(lambda r, q: F.abs(r - q)).alias("l1"), total(lambda r, q: (r - q) * (r - q)).alias("l2"))
    target = F.col("qr").cast("double") * F.col("qr").cast("double") / F.col("rr")
    sdr = F.when(F.col("qq") * F.col("rr") == F.col("qr") * F.col("qr"), 99.0).otherwise(10 * F.log10(target / (F.col("qq") - target)))
    return s.select("id", "l1", F.round(F.col("l2") / 64.0 / 1e8, 9).alias("mse"), F.round(sdr, 4).alias("si_sdr"))


@query(
    "kmeans",
    f"with {NEAR}, m as (select near.code, e.d, floor((2 * sum(e.v) + count(*)) / (2 * count(*))) as m from near join e using (id) "
    "group by 1, 2), c as (select b.code, b.d, cast(coalesce(m.m, b.v) as bigint) as v from b left join m using (code, d)), "
    "dist2 as (select e.id, c.code, sum((e.v - c.v) * (e.v - c.v)) as s from e join c using (d) group by 1, 2), "
    "near2 as (select id, arg_min(code, (s, code)) as code from dist2 group by 1), n2 as (select code, count(*) as size from near2 group by 1) "
    "select c.code, coalesce(max(n2.size), 0) as size, cast(sum(v * (d + 1)) as bigint) as checksum from c left join n2 using (code) group by 1",
)
def kmeans(spark, d):
    rows = whole(spark, d)
    return vec.kmeans(rows, book(rows, 0, 16), 1).select("code", "size", F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


@query(
    "ema_codebook",
    f"with {NEAR}, s as (select near.code, count(distinct near.id) as n, sum(e.v * (e.d + 1)) as t from near join e using (id) group by 1), "
    "u as (select bb.code, 0.9::double + 0.1::double * coalesce(n, 0) as size, 0.9::double * bb.t + 0.1::double * coalesce(s.t, 0) as t "
    "from (select code, sum(v * (d + 1)) as t from b group by 1) bb left join s using (code)) "
    "select code, round(size, 6) as size, round(t / ((size + 0.00001) / ((select sum(size) from u) + 16 * 0.00001) * (select sum(size) "
    "from u)), 3) as checksum from u",
)
def ema_codebook(spark, d):
    rows = whole(spark, d)
    codes = book(rows, 0, 16)
    hit = vec.nearest(rows, codes).select("code", "id", F.posexplode("vec").alias("d", "v"))
    sums = hit.groupBy("code", "d").agg(F.sum("v").cast("double").alias("s"), F.count("*").alias("c"))
    batch = sums.groupBy("code").agg(F.max("c").alias("count"), F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("sum"))
    start = codes.select("code", F.lit(1.0).alias("size"), F.transform("vec", lambda x: x.cast("double")).alias("total"))
    out = vec.ema_update(start, batch, 0.9)
    return out.select("code", F.round("size", 6).alias("size"), F.round(F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 3).alias("checksum"))


POOL = "pool as (select vec_id as id, row_number() over (order by md5(vec_id::varchar || ':7'), vec_id) - 1 as r from embeddings)"


@query(
    "dead_codes",
    f"with {NEAR}, n as (select k.code, count(near.id) as n from (select unnest(range(0, 16)) as code) k left join near using (code) "
    f"group by 1), {POOL}, ranked as (select code, n, n < 40 as dead, row_number() over (partition by n < 40 order by code) - 1 as r from n), "
    "v as (select ranked.code, ranked.dead, ranked.n, e.d, case when dead then e.v else b.v end as v from ranked left join pool using (r) "
    "join e on e.id = pool.id join b on b.code = ranked.code and b.d = e.d) "
    "select code, dead as replaced, case when dead then 40.0::double else n::double end as size, cast(sum(v * (d + 1)) as bigint) as checksum "
    "from v group by 1, 2, n",
)
def dead_codes(spark, d):
    """The codebook with its rarely used codes replaced by drawn vectors."""
    rows = whole(spark, d)
    codes = book(rows, 0, 16)
    hits = vec.nearest(rows, codes).groupBy("code").agg(F.count("*").alias("size"))
    used = codes.join(hits, "code", "left").fillna(0, ["size"])
    return vec.replace_dead(used, rows, 7, 40.0).select("code", "replaced", "size", checksum())


@query(
    "codebook_init",
    f"with {E}, {POOL}, b as (select pool.r as code, e.d, e.v from pool join e using (id) where r < 8), "
    "dist as (select e.id, b.code, sum((e.v - b.v) * (e.v - b.v)) as s from e join b using (d) group by 1, 2), "
    "near as (select id, arg_min(code, (s, code)) as code from dist group by 1), n as (select code, count(*) as size from near group by 1) "
    "select b.code, coalesce(max(n.size), 0) as size, cast(sum(v * (d + 1)) as bigint) as checksum from b left join n using (code) group by 1",
)
def codebook_init(spark, d):
    """Drawn vectors as a first codebook, without rounds."""
    return vec.init_codebook(whole(spark, d), 8, 0, 7).select("code", "size", checksum())


@query("kmeans_rounds")
def kmeans_rounds(spark, d):
    return vec.init_codebook(whole(spark, d), 8, 5, 7).select("code", "size", checksum())


@query(
    "decode_latents",
    f"with {NEAR} select near.id, near.code, cast(sum(b.v * (b.d + 1)) as bigint) as checksum from near join b using (code) group by 1, 2",
)
def decode_latents(spark, d):
    """The nearest code of a latent vector, and that code's vector."""
    rows = whole(spark, d)
    codes = book(rows, 0, 16)
    found = vec.nearest(rows, codes).select("id", F.array("code").alias("codes"))
    return vec.dequantize(found, [codes]).join(found, "id").select("id", F.get("codes", F.lit(0)).alias("code"), checksum())


@query(
    "embedding_sum",
    f"with {E}, g as (select user_id as b, n // 9 as t, n % 9 as c, x % 64 as token "
    "from (select user_id, row_number() over (partition by user_id order by ts) - 1 as n, cast(round(value * 100) as bigint) as x from events)) "
    "select g.b, g.t, cast(sum(e.v * (e.d + 1)) as bigint) as checksum from g join e on e.id = g.c * 16 + g.token % 16 group by 1, 2",
)
def embedding_sum(spark, d):
    """Nine channels of tokens, each with its own table of 64 vectors (16 different ones)."""
    from corvane.operators import signal as sig

    s = sig.from_events(spark.read.parquet(f"{d}/events.parquet"))
    grid = s.select(F.col("signal_id").alias("b"), F.floor(F.col("n") / 9).alias("t"), (F.col("n") % 9).cast("int").alias("c"), (F.col("x") % 64).cast("int").alias("token"))
    tables = whole(spark, d).where("id < 144").select(F.expr("cast(id div 16 as int)").alias("c"), F.explode(F.sequence((F.col("id") % 16).cast("int"), F.lit(63), F.lit(16))).alias("token"), "vec")
    return vec.embedding_sum(grid, tables).select("b", "t", checksum())


@query(
    "l2_normalized",
    f"with {E}, n as (select id, sqrt(sum(v * v)) as s, sqrt(sum(v * v) / 64.0::double / 1e8::double + 1e-5::double) as r from e group by 1) "
    "select id, d, round(v / s, 8) + 0.0 as x, round(v / 10000 / r, 6) + 0.0 as rms from e join n using (id)",
)
def l2_normalized(spark, d):
    x = whole(spark, d).select("id", F.transform("vec", lambda v: v / 10000.0).alias("x"))
    both = x.select("id", F.posexplode(F.arrays_zip(att.l2_normalize(F.col("x")).alias("x"), att.rms_norm(F.col("x")).alias("rms"))).alias("d", "z"))
    return both.select("id", F.col("d").cast("long").alias("d"), (F.round("z.x", 8) + 0.0).alias("x"), (F.round("z.rms", 6) + 0.0).alias("rms"))


@query(
    "weight_norms",
    f"with {E}, n as (select id, sqrt(sum(v * v)) as s from e group by 1) "
    "select id, round(sum(2.5::double * v / s * (d + 1)), 6) + 0.0 as checksum from e join n using (id) group by 1",
)
def weight_norms(spark, d):
    w = att.weight_norm(F.transform("vec", lambda v: v / 10000.0), F.lit(2.5))
    return whole(spark, d).select("id", (F.round(F.aggregate(F.transform(w, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("checksum"))


@query(
    "l2_norms",
    f"with {E} "
    "select id, round(sqrt(sum(v * v)::double) / 10000, 8) as norm, round(sum(abs(v)) / 10000.0::double, 6) as l1, round(max(abs(v)) / "
    "10000.0::double, 6) as peak from e group by 1",
)
def l2_norms(spark, d):
    fold = lambda f: F.aggregate("vec", F.lit(0).cast("long"), f)
    return whole(spark, d).select("id", F.round(F.sqrt(fold(lambda s, x: s + x * x).cast("double")) / 10000, 8).alias("norm"), F.round(fold(lambda s, x: s + F.abs(x)) / 10000.0, 6).alias("l1"), F.round(F.array_max(F.transform("vec", F.abs)) / 10000.0, 6).alias("peak"))


SPECTRUM = f"{E}, k as (select unnest(range(0, 33)) as k), s as (select id, k, sum(v * cos(2 * pi() * k * d / 64.0::double)) as re, -sum(v * sin(2 * pi() * k * d / 64.0::double)) as im from e, k group by 1, 2)"


def _spectrum(spark, d, window="ones"):
    return vec.spectrum(whole(spark, d).select("id", F.col("vec").alias("x")), window)


@query("spectrum_magnitude", f"with {SPECTRUM} select id, cast(k as int) as bin, round(sqrt(re * re + im * im), 4) as magnitude from s")
def spectrum_magnitude(spark, d):
    return _spectrum(spark, d).select("id", "bin", F.round(F.hypot("re", "im"), 4).alias("magnitude"))


@query(
    "spectrum_log_magnitude",
    f"with {SPECTRUM}, l as (select id, k, 10 * log10(greatest(re * re + im * im, 1e-10)) as db from s) "
    "select id, cast(k as int) as bin, round(greatest(db, max(db) over (partition by id) - 40), 5) as db from l",
)
def spectrum_log_magnitude(spark, d):
    return vec.log_magnitude(_spectrum(spark, d), top_db=40.0).withColumn("db", F.round("db", 5))


@query(
    "tapered_spectrum",
    f"with {E}, k as (select unnest(range(0, 33)) as k), "
    "s as (select id, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * d / 64.0::double)) * cos(2 * pi() * k * d / 64.0::double)) as re, sum(v * (0.5 - "
    "0.5 * cos(2 * pi() * d / 64.0::double)) * sin(2 * pi() * k * d / 64.0::double)) as im from e, k group by 1, 2) "
    "select id, cast(k as int) as bin, round(sqrt(re * re + im * im), 4) as magnitude from s",
)
def tapered_spectrum(spark, d):
    return _spectrum(spark, d, "hann").select("id", "bin", F.round(F.hypot("re", "im"), 4).alias("magnitude"))


_MEL = vec.mel_weights(8, 33, 16000.0)
_MEL_SQL = ", ".join(f"({m}, {k}, {w!r}::double)" for m, k, w in _MEL)


@query(
    "mel_spectrogram",
    f"with {SPECTRUM}, w(mel, k, w) as (values {_MEL_SQL}) select id, mel, round(sum(sqrt(re * re + im * im) * w), 3) as value from s "
    "join w using (k) group by 1, 2",
)
def mel_spectrogram(spark, d):
    return vec.mel_spectrogram(_spectrum(spark, d), _MEL).withColumn("value", F.round("value", 3))


_DCT = vec.dct_matrix(4, 8)
_DCT_SQL = ", ".join(f"({k}, {i}, {w!r}::double)" for k, i, w in _DCT)


@query(
    "mfcc",
    f"with {SPECTRUM}, w(mel, k, w) as (values {_MEL_SQL}), m as (select id, mel, ln(sum(sqrt(re * re + im * im) * w) + 1e-6) as l from s "
    f"join w using (k) group by 1, 2), c(c, mel, w) as (values {_DCT_SQL}) select id, c, round(sum(l * w), 5) as value from m join c using (mel) "
    "group by 1, 2",
)
def mfcc(spark, d):
    mel = vec.mel_spectrogram(_spectrum(spark, d), _MEL).withColumn("l", F.log(F.col("value") + 1e-6))
    table = spark.createDataFrame(_DCT, "c int, mel int, w double")
    return mel.join(F.broadcast(table), "mel").groupBy("id", "c").agg(F.round(F.sum(F.col("l") * F.col("w")), 5).alias("value"))


@query(
    "mask_frequencies",
    f"with {SPECTRUM} "
    "select id, cast(k as int) as bin, round(case when 8000.0 * k / 32 >= 1000 and 8000.0 * k / 32 < 3000 then 0 else sqrt(re * re + im * im) "
    "end, 4) as magnitude from s",
)
def mask_frequencies(spark, d):
    hz = 8000.0 * F.col("bin") / 32
    return _spectrum(spark, d).select("id", "bin", F.round(F.when((hz >= 1000) & (hz < 3000), 0.0).otherwise(F.hypot("re", "im")), 4).alias("magnitude"))


@query(
    "compare_vectors",
    f"with {E} "
    "select a.id, round(avg(abs(a.v - b.v)) / 10000, 6) as mean_error, round(max(abs(a.v - b.v)) / 10000.0::double, 6) as max_error, "
    "round(corr(a.v, b.v), 8) as r from e a join e b on b.id = a.id + 1 and b.d = a.d group by 1",
)
def compare_vectors(spark, d):
    e = whole(spark, d).select("id", F.posexplode("vec").alias("d", "v"))
    a = e
    b = e.select((F.col("id") - 1).alias("id"), "d", F.col("v").alias("w"))
    return a.join(b, ["id", "d"]).groupBy("id").agg(F.round(F.avg(F.abs(F.col("v") - F.col("w"))) / 10000, 6).alias("mean_error"), F.round(F.max(F.abs(F.col("v") - F.col("w"))) / 10000.0, 6).alias("max_error"), F.round(F.corr("v", "w"), 8).alias("r"))


@query(
    "rotary_embedding",
    f"with {E} "
    "select a.id, a.d, round((a.v * cos(a.id % 64 / pow(10000, a.d / 32.0::double)) - b.v * sin(a.id % 64 / pow(10000, a.d / 32.0::double))) / "
    "10000, 7) + 0.0 as x, round((b.v * cos(a.id % 64 / pow(10000, a.d / 32.0::double)) + a.v * sin(a.id % 64 / pow(10000, a.d / 32.0::double))) "
    "/ 10000, 7) + 0.0 as y from e a join e b on b.id = a.id and b.d = a.d + 32 where a.d < 32",
)
def rotary_embedding(spark, d):
    turned = att.rope(F.transform("vec", lambda v: v / 10000.0), F.col("id") % 64)
    rows = whole(spark, d).select("id", turned.alias("r"))
    cells = rows.select("id", F.posexplode(F.arrays_zip(F.slice("r", 1, 32).alias("x"), F.slice("r", 33, 32).alias("y"))).alias("d", "z"))
    return cells.select("id", F.col("d").cast("long").alias("d"), (F.round("z.x", 7) + 0.0).alias("x"), (F.round("z.y", 7) + 0.0).alias("y"))
