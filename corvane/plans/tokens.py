"""Token queries over `conversations`, `events` and `embeddings`, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import attention as att
from corvane.operators import coder
from corvane.operators import signal as sig
from corvane.operators import tokens as tok
from corvane.sources.containers import header_json

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


GRID = "g as (select user_id as b, n // 9 as t, cast(n % 9 as int) as c, cast(x % 1024 as int) as token from (select user_id, row_number() over (partition by user_id order by ts) - 1 as n, count(*) over (partition by user_id) as len, cast(round(value * 100) as bigint) as x from events) where n < len - len % 9)"


def grid(spark, d):
    s = sig.length(sig.from_events(spark.read.parquet(f"{d}/events.parquet")))
    return s.where(F.col("n") < F.col("len") - F.col("len") % 9).select(F.col("signal_id").alias("b"), F.floor(F.col("n") / 9).alias("t"), (F.col("n") % 9).cast("int").alias("c"), (F.col("x") % 1024).cast("int").alias("token"))


_SHORT = (0, 1, 1, 2, 2, 3, 3, 4, 4)
_CASE = "case c " + " ".join(f"when {c} then {x}" for c, x in enumerate(_SHORT)) + " end"


@query("apply_delay", f"with {GRID} select b, t, c, coalesce(case c " + " ".join(f"when {c} then lag(token, {x}) over w" for c, x in enumerate(_SHORT)) + " end, 1026) as token from g window w as (partition by b, c order by t)")
def apply_delay(spark, d):
    return tok.apply_delay(grid(spark, d), _SHORT)


@query("revert_delay", f"with {GRID} select b, t, c, coalesce(case c " + " ".join(f"when {c} then lead(token, {x}) over w" for c, x in enumerate(_SHORT)) + " end, last_value(token) over (partition by b, c order by t rows between unbounded preceding and unbounded following)) as token from g window w as (partition by b, c order by t)")
def revert_delay(spark, d):
    return tok.revert_delay(grid(spark, d), _SHORT)


@query(
    "end_countdown",
    f"with {GRID}, e as (select b, t, c, case when c = 0 and token % 5 = 0 then 1024 else token end as token from g), "
    f"f as (select *, min(t) filter (c = 0 and token = 1024) over (partition by b) as t0, {_CASE} as d from e) "
    "select b, t, c, case when t - t0 - d = 0 then 1024 when t - t0 - d > 0 then 1025 else token end as token from f",
)
def end_countdown(spark, d):
    e = grid(spark, d).withColumn("token", F.when((F.col("c") == 0) & (F.col("token") % 5 == 0), 1024).otherwise(F.col("token")))
    return tok.end_countdown(e, _SHORT)


@query(
    "byte_tokens",
    "select conv_id, turn, substr(hex(encode(replace(replace((case role when 'user' then '[S1]' else '[S2]' end) || text, '[S1]', chr(1)), "
    "'[S2]', chr(2)))), 1, 2048) as tokens from conversations",
)
def byte_tokens(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    text = F.concat(F.when(F.col("role") == "user", "[S1]").otherwise("[S2]"), F.col("text"))
    return c.select("conv_id", "turn", tok.byte_tokens(text).alias("tokens"))


@query(
    "padded_tokens",
    "with h as (select conv_id, turn, substr(hex(encode(text)), 1, 2048) as h from conversations), "
    "b as (select conv_id, turn, i, case when 2 * i < length(h) then cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as int) else 0 end as "
    "v from h, (select unnest(range(0, 1024)) as i)) select conv_id, turn, cast(sum(v * (i + 1)) as bigint) as checksum, count(*) as size from b "
    "group by 1, 2",
)
def padded_tokens(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    padded = c.select("conv_id", "turn", tok.byte_array(tok.byte_tokens(F.col("text")), 1024).alias("a"))
    checksum = F.aggregate(F.transform("a", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return padded.select("conv_id", "turn", checksum.alias("checksum"), F.size("a").cast("long").alias("size"))


LOGITS = "l as (select vec_id as row, unnest(range(0, 64)) as token, cast(round(exp(10 * round(unnest(embedding)::double, 6)) * 1000) as bigint) as weight from embeddings), k as (select * from (select *, row_number() over (partition by row order by weight desc, token) as rank from l) where rank <= 45)"
NUCLEUS = f"{LOGITS}, p as (select * from (select *, coalesce(sum(weight) over (partition by row order by rank rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (partition by row) as total from k) where before * 100 <= total * 95)"


def logits(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("token", "v"))
    return e.select("row", F.col("token").cast("long").alias("token"), F.round(F.exp(10 * F.round(F.col("v").cast("double"), 6)) * 1000).cast("long").alias("weight"))


@query("greedy_token", f"with {LOGITS} select row, token, weight from k where rank = 1")
def greedy_token(spark, d):
    best = F.max_by(F.struct("token", "weight"), F.struct("weight", -F.col("token")))
    return logits(spark, d).groupBy("row").agg(best.alias("b")).select("row", "b.token", "b.weight")


@query("top_k", f"with {LOGITS} select row, token, weight, cast(rank as int) as rank from k")
def top_k(spark, d):
    return tok.top_k(logits(spark, d), 45)


@query("top_p", f"with {NUCLEUS} select row, token, weight, cast(rank as int) as rank from p")
def top_p(spark, d):
    return tok.top_p(tok.top_k(logits(spark, d), 45), 95, 100).select("row", "token", "weight", "rank")


UNIFORM = "(cast('0x' || substr(md5(row::varchar), 1, 8) as bigint) / 4294967296.0::double)"


@query(
    "multinomial_draw",
    f"with {NUCLEUS}, r as (select *, sum(weight) over (partition by row order by rank) as run, sum(weight) over (partition by row) as all_ "
    f"from p) select row, arg_min(token, rank) as token from r where run > {UNIFORM} * all_ group by 1",
)
def multinomial_draw(spark, d):
    kept = tok.top_p(tok.top_k(logits(spark, d), 45), 95, 100)
    return tok.draw(kept, tok.hashed_uniform(F.col("row")))


@query(
    "end_unless_best",
    f"with {LOGITS} select row, count(*) filter (not (token = 63 and rank > 1)) as n, coalesce(max(rank) filter (token = 63), 0) as end_rank "
    "from k group by 1",
)
def end_unless_best(spark, d):
    k = tok.top_k(logits(spark, d), 45)
    return k.groupBy("row").agg(F.count_if(~((F.col("token") == 63) & (F.col("rank") > 1))).alias("n"), F.coalesce(F.max(F.when(F.col("token") == 63, F.col("rank").cast("long"))), F.lit(0).cast("long")).alias("end_rank"))


@query(
    "guidance",
    "with e as (select vec_id, unnest(range(0, 64)) as token, cast(round(unnest(embedding)::double * 10000) as bigint) as v from embeddings), "
    "p as (select a.vec_id // 2 as row, a.token, a.v + 3 * (a.v - b.v) as v from e a join e b on b.vec_id = a.vec_id + 1 and b.token = a.token "
    "where a.vec_id % 2 = 0), m as (select row, token, case when token > 62 then null when token = 62 then trunc(v * 4 / 5) else v end as v "
    "from p) select row, cast(sum(v * (token + 1)) as bigint) as checksum, arg_max(token, (v, -token)) as best from m where v is not null "
    "group by 1",
)
def guidance(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long"))).alias("token", "v"))
    a = e.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("row"), "token", F.col("v").alias("cond"))
    b = e.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("row"), "token", F.col("v").alias("free"))
    v = F.col("cond") + 3 * (F.col("cond") - F.col("free"))
    rows = a.join(b, ["row", "token"]).withColumn("v", v).withColumn("v", F.when(F.col("token") > 62, None).when(F.col("token") == 62, F.expr("v * 4 div 5")).otherwise(F.col("v"))).where("v is not null")
    return rows.groupBy("row").agg(F.sum(F.col("v") * (F.col("token") + 1)).alias("checksum"), F.max_by("token", F.struct("v", -F.col("token"))).cast("long").alias("best"))


@query(
    "quantized_cdf",
    "with n as (select length(event_type) * 100 + ascii(event_type) as symbol, count(*) as n from events group by 1), "
    "w as (select symbol, n * (4096 - (select count(*) from n) * 2) // (select sum(n) from n) + 2 as width from n) "
    "select cast(symbol as int) as symbol, cast(width as bigint) as width, cast(sum(width) over (order by symbol) - width as bigint) as low, "
    "cast(sum(width) over (order by symbol) as bigint) as high from w",
)
def quantized_cdf(spark, d):
    n = spark.read.parquet(f"{d}/events.parquet").groupBy((F.length("event_type") * 100 + F.ascii("event_type")).alias("symbol")).agg(F.count("*").alias("n"))
    return tok.quantized_cdf(n)


CODES = "c as (select user_id as stream, row_number() over (partition by user_id order by ts) - 1 as pos, cast(cast(round(value * 100) as bigint) % 1024 as bigint) as code from events)"


def codes(spark, d):
    return sig.from_events(spark.read.parquet(f"{d}/events.parquet")).select(F.col("signal_id").alias("stream"), F.col("n").alias("pos"), (F.col("x") % 1024).cast("int").alias("code"))


@query(
    "pack_bits",
    f"with {CODES}, x as (select stream, pos * 10 + k as place, (code >> k) & 1 as bit from c, (select unnest(range(0, 10)) as k)) "
    "select stream, place // 8 as byte, cast(sum(bit << (place % 8)) as int) as value from x group by 1, 2",
)
def pack_bits(spark, d):
    return tok.pack_bits(codes(spark, d), 10)


@query("unpack_bits", f"with {CODES} select stream, pos, cast(code as int) as code from c")
def unpack_bits(spark, d):
    return tok.unpack_bits(tok.pack_bits(codes(spark, d), 10), 10)


_ROWS = "x as (select vec_id // 16 as seq, vec_id % 16 as pos, cast(label % 2 as int) as pad, unnest(range(0, 64)) as d, round(unnest(embedding)::double, 4) as v from embeddings)"


def _attention_sql(seen: str) -> str:
    return f"with {_ROWS}, p as (select q.seq, q.pos, k.pos as k, sum(q.v * k.v) / 8.0::double as score from x q join x k on k.seq = q.seq and k.d = q.d where {seen} group by 1, 2, 3), w as (select *, exp(score) as w from p), y as (select w.seq, w.pos, v.d, sum(w.w * v.v) / sum(w.w) as y, count(*) as keys from w join x v on v.seq = w.seq and v.pos = w.k group by 1, 2, 3) select seq, pos, max(keys) as keys, round(sum(y * (d + 1)), 5) + 0.0 as checksum from y group by 1, 2"


def _attention(spark, d, **masks):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))
    rows = rows.select(F.expr("vec_id div 16").alias("seq"), (F.col("vec_id") % 16).alias("pos"), (F.col("label") % 2).cast("int").alias("pad"), F.col("v").alias("q"), F.col("v").alias("k"), "v")
    out = att.attend(rows, **masks)
    total = F.aggregate(F.transform("y", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("seq", "pos", "keys", (F.round(total, 5) + 0.0).alias("checksum"))


@query("causal_attention", _attention_sql("k.pos <= q.pos"))
def causal_attention(spark, d):
    """Sixteen vectors a sequence, each sees those up to it."""
    return _attention(spark, d, causal=True)


@query("padded_attention", _attention_sql("k.pad = q.pad"))
def padded_attention(spark, d):
    return _attention(spark, d, padded=True)


@query("combined_attention", _attention_sql("k.pad = q.pad and k.pos <= q.pos"))
def combined_attention(spark, d):
    return _attention(spark, d, causal=True, padded=True)


@query(
    "sinusoids",
    "with p as (select conv_id, turn, unnest(range(0, 8)) as i from conversations) "
    "select conv_id, turn, round(sum((i + 1) * sin(turn / pow(10000, 2.0 * i / 16)) + (i + 9) * cos(turn / pow(10000, 2.0 * i / 16))), 6) + 0.0 "
    "as checksum from p group by 1, 2",
)
def sinusoids(spark, d):
    total = F.aggregate(F.transform(att.sinusoid(F.col("turn"), 16), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", (F.round(total, 6) + 0.0).alias("checksum"))


@query(
    "rotated_halves",
    "with e as (select vec_id, unnest(range(0, 64)) as d, cast(round(unnest(embedding)::double * 10000) as bigint) as v from embeddings) "
    "select vec_id, cast(sum(case when d >= 32 then -v * (d - 31) else v * (d + 33) end) as bigint) as checksum from e group by 1",
)
def rotated_halves(spark, d):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long"))
    total = F.aggregate(F.transform(att.rotate_half(whole), lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", total.alias("checksum"))


@query("repeated_heads", "select conv_id, turn * 3 + k as head, length(text) as len from conversations, (select unnest(range(0, 3)) as k)")
def repeated_heads(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("head"), F.char_length("text").cast("long").alias("len"))
    return att.repeat_heads(rows, 3)


@query(
    "dense_general",
    "select s_nationkey, l_returnflag, cast(sum(cast(round(s_acctbal * 100) as bigint) * q) as bigint) as x "
    "from (select l_suppkey, l_returnflag, sum(cast(l_quantity as bigint)) as q from lineitem group by 1, 2) l "
    "join supplier on s_suppkey = l_suppkey group by 1, 2",
)
def dense_general(spark, d):
    """Sums of products of two tensors over the supplier."""
    a = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("supplier"), "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("x"))
    b = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("supplier"), "s_nationkey", F.round(F.col("s_acctbal") * 100).cast("long").alias("x"))
    return att.contract(a, b, ["supplier"])


_W = [(o, c, t, (o + 1) * 3 - 2 * c + t) for o in range(2) for c in range(2) for t in range(3)]
_W_SQL = ", ".join(str(w) for w in _W)


@query(
    "conv1d",
    "with sig as (select user_id as signal_id, row_number() over (partition by user_id order by ts) - 1 as n, count(*) over (partition by "
    "user_id) as len, cast(round(value * 100) as bigint) as x from events), "
    "c as (select signal_id, n % 2 as channel, n // 2 as n, len // 2 as len, x from sig where n < len - len % 2), "
    f"w(o, channel, tap, w) as (values {_W_SQL}) select signal_id, o as channel, loc // 2 as n, cast(sum(x * w) as bigint) as x "
    "from (select signal_id, o, x, w, len, n + 4 - tap * 2 as loc from c join w using (channel)) where loc >= 0 and loc < len and loc % 2 = 0 "
    "group by 1, 2, 3",
)
def conv1d(spark, d):
    """Two channels to two through three taps, dilated by two, every second output."""
    rows = sig.deinterleave(sig.from_events(spark.read.parquet(f"{d}/events.parquet")))
    weights = spark.createDataFrame(_W, "out int, channel int, tap int, w int")
    return att.conv1d(rows, weights, 3, 2, 2).withColumn("x", F.col("x").cast("long"))


SCORES = "s as (select user_id as id, event_type as layer, value / 500 as real, (value * 7 % 500) / 500 as fake from events)"


def scores(spark, d):
    v = F.col("value")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_type").alias("layer"), (v / 500).alias("real"), ((v * 7) % 500 / 500).alias("fake"))


@query(
    "gan_losses",
    f"with {SCORES} select id, round(avg(pow(1 - real, 2)) + avg(pow(fake, 2)), 6) as discriminator, round(avg(pow(1 - fake, 2)), 6) as generator "
    "from s group by 1",
)
def gan_losses(spark, d):
    return att.gan_losses(scores(spark, d)).select("id", F.round("discriminator", 6).alias("discriminator"), F.round("generator", 6).alias("generator"))


@query(
    "feature_loss",
    f"with {SCORES} select id, round(sum(l), 8) as loss from (select id, layer, avg(abs(real - fake)) as l from s group by 1, 2) group by 1",
)
def feature_loss(spark, d):
    return att.feature_loss(scores(spark, d)).withColumn("loss", F.round("loss", 8))


@query(
    "filled_grid",
    f"with {GRID}, new as (select b, t, c, 7 as token from g where token % 3 = 0), "
    "old as (select b, t, c, case when token % 2 = 0 then -1 else token end as token from g) "
    "select old.b, old.t, old.c, case when old.token = -1 and new.token is not null then new.token else old.token end as token from old left "
    "join new using (b, t, c)",
)
def filled_grid(spark, d):
    g = grid(spark, d)
    old = g.withColumn("token", F.when(F.col("token") % 2 == 0, -1).otherwise(F.col("token")))
    return tok.fill_grid(old, g.where("token % 3 = 0").withColumn("token", F.lit(7)))


@query("open_grid", "select b, t, cast(c as int) as c, -1 as token from range(0, 3) x(b), range(0, 5) y(t), range(0, 9) z(c)")
def open_grid(spark, d):
    return tok.open_grid(spark, 3, 5, 9)


_U = "(cast('0x' || substr(md5(key::varchar || ':{}'), 1, 8) as bigint) / 4294967296.0::double)"


@query(
    "chosen_items",
    "with o as (select o_custkey as key, o_orderpriority as grp, cast(substr(o_orderpriority, 1, 1) as bigint) as weight, o_orderkey as item "
    "from orders), g as (select key, grp, max(weight) as weight, list(item order by item) as items from o group by 1, 2), "
    "r as (select *, sum(weight) over (partition by key order by grp) as run, sum(weight) over (partition by key) as all_ from g), "
    f"h as (select key, arg_min(grp, grp) as grp, arg_min(items, grp) as items from r where run > {_U.format('group')} * all_ group by 1) "
    f"select key, grp, items[cast(floor({_U.format('item')} * len(items)) as bigint) + 1] as item from h",
)
def chosen_items(spark, d):
    """An order of each customer: a priority by weight, then one of its orders."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("grp"), F.substring("o_orderpriority", 1, 1).cast("long").alias("weight"), F.col("o_orderkey").alias("item"))
    return tok.choose(o, F.col("key"))


@query(
    "drawn_numbers",
    "with k as (select event_id as key from events) "
    f"select key as event_id, 3.5::double as const, round(2 + (5 - 2) * {_U.format('u')}, 8) as uniform, round(1 + 2 * sqrt(-2 * ln(1 - "
    f"{_U.format('a')})) * cos(2 * pi() * {_U.format('b')}), 7) + 0.0 as normal from k",
)
def drawn_numbers(spark, d):
    draw = lambda *a: tok.sample_distribution(F.col("event_id"), *a)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", draw("const", 3.5).alias("const"), F.round(draw("uniform", 2, 5), 8).alias("uniform"), (F.round(draw("normal", 1, 2), 7) + 0.0).alias("normal"))


_CDF = coder.stable_cdf([1 / 1024] * 1024)


@query("arithmetic_round_trip", f"with {CODES} select stream, pos, cast(code as int) as code from c")
def arithmetic_round_trip(spark, d):
    return coder.arithmetic_decode(coder.arithmetic_encode(codes(spark, d), _CDF), _CDF)


@query("arithmetic_sizes")
def arithmetic_sizes(spark, d):
    return coder.arithmetic_encode(codes(spark, d), _CDF).select("stream", "n", F.length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha"))


FRAMES = f"{CODES}, f as (select stream, pos // 8 as frame, (pos % 8) // 2 as t, cast(pos % 2 as int) as k, cast(code as int) as code, case when (pos // 8) % 2 = 0 then cast(1.5 + pos // 8 as float) end as scale from (select *, count(*) over (partition by stream) as len from c) where pos < len - len % 8)"


def coded_frames(spark, d):
    c = codes(spark, d).withColumn("len", F.count("*").over(Window.partitionBy("stream"))).where("pos < len - len % 8")
    frame = F.floor(F.col("pos") / 8)
    return c.select("stream", frame.alias("frame"), F.floor(F.col("pos") % 8 / 2).alias("t"), (F.col("pos") % 2).cast("int").alias("k"), "code", F.when(frame % 2 == 0, (1.5 + frame).cast("float")).alias("scale"))


@query("compress_packed", f"with {FRAMES} select * from f")
def compress_packed(spark, d):
    return coder.decompress(coder.compress(coded_frames(spark, d), 10, "model", 24000), 10)


@query("compress_arithmetic", f"with {FRAMES} select * from f")
def compress_arithmetic(spark, d):
    return coder.decompress(coder.compress(coded_frames(spark, d), 10, "model", 24000, "arithmetic", _CDF), 10, _CDF)


@query("compressed_headers", f"with {FRAMES} select stream, 'model' as m, count(*) // 2 as al from f group by 1")
def compressed_headers(spark, d):
    files = coder.compress(coded_frames(spark, d), 10, "model", 24000)
    head = F.from_json(header_json(F.col("data")), "m string, al long")
    return files.select("stream", head.alias("h")).select("stream", "h.m", "h.al")


@query("bracket_cleanup", "select conv_id, turn, replace(replace('[[' || text || ']]', '[[', '['), ']]', ']') as text from conversations")
def bracket_cleanup(spark, d):
    t = F.concat(F.lit("[["), "text", F.lit("]]"))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.replace(F.replace(t, F.lit("[["), F.lit("[")), F.lit("]]"), F.lit("]")).alias("text"))


@query(
    "speed_factor",
    "select conv_id, turn, round(case when length(text) > 400 then 1 - 0.2 * least(1.0, (length(text) - 400) / 350.0::double) else 1.0 end, 9) "
    "as factor from conversations",
)
def speed_factor(spark, d):
    n = F.char_length("text")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.round(F.when(n > 400, 1 - 0.2 * F.least(F.lit(1.0), (n - 400) / 350.0)).otherwise(1.0), 9).alias("factor"))
