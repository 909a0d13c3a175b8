"""Catalogue, diagnostics and set queries, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane import runtime
from corvane.functions import scalar as S
from corvane.operators import catalog as cat
from corvane.sources import containers as box
from corvane.streaming import state

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "wildcard_urls",
    "select page_id, regexp_matches(url, '(?is)^https?://.*\\.example\\.com/.*$') as com, regexp_matches(url, '(?is)^.*/EN/.*$') as en from pages",
)
def wildcard_urls(spark, d):
    return table(spark, d, "pages").select("page_id", (cat.wildcard(F.col("url"), "http://*.example.com/*") | cat.wildcard(F.col("url"), "https://*.example.com/*")).alias("com"), cat.wildcard(F.col("url"), "*/EN/*").alias("en"))


@query(
    "url_parts",
    "select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, "
    "'://[^/?#]*([^?#]*)', 1) as path from pages",
)
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))


@query(
    "allowed_hosts",
    "select page_id, url from pages "
    "where regexp_extract(url, '^([a-z]+)://', 1) in ('http', 'https') and ends_with(regexp_extract(url, '://([^/?#]*)', 1), '.example.org')",
)
def allowed_hosts(spark, d):
    return table(spark, d, "pages").where(F.parse_url("url", F.lit("PROTOCOL")).isin("http", "https") & F.parse_url("url", F.lit("HOST")).endswith(".example.org")).select("page_id", "url")


@query(
    "source_route",
    "with s as (select page_id, case page_id % 3 when 0 then url when 1 then split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) || '/' "
    "|| page_id else '/data/' || page_id || '.pt' end as source from pages) "
    "select page_id, case when regexp_matches(source, '^https?://') then 'url' when length(source) - length(replace(source, '/', '')) = 1 and "
    "not contains(source, ':') and not starts_with(source, '/') then 'hub' else 'local' end as route from s",
)
def source_route(spark, d):
    host = F.split_part(F.parse_url("url", F.lit("HOST")), F.lit("."), F.lit(1))
    source = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(host, F.lit("/"), F.col("page_id"))).otherwise(F.concat(F.lit("/data/"), F.col("page_id"), F.lit(".pt")))
    return table(spark, d, "pages").select("page_id", cat.route(source).alias("route"))


_EXT = ["pt", "JSON", "onnx", "xyz", "safetensors", "h5", ""]
_TYPES = ["pytorch", "config", "onnx", "unknown", "safetensors", "keras", "unknown"]


@query("file_types", "select page_id, case page_id % 7 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(_TYPES)) + " end as type from pages")
def file_types(spark, d):
    name = F.concat(F.lit("model"), F.col("page_id"), F.get(F.array(*[F.lit(f".{e}" if e else "") for e in _EXT]), (F.col("page_id") % 7).cast("int")))
    return table(spark, d, "pages").select("page_id", cat.file_type(name).alias("type"))


@query("content_hash", "select doc_id, sha256(text) as sha, octet_length(encode(text)) as bytes from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"))


@query("duplicate_files", "select sha256(text) as sha, count(*) as copies, min(doc_id) as first from documents group by 1 having count(*) > 1")
def duplicate_files(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("missing_files", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def missing_files(spark, d):
    return cat.missing(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(
    "size_mismatch",
    "with l as (select l_orderkey, count(*) as n, max(l_linenumber) as m from lineitem group by 1) select o_orderkey, n, m from orders "
    "join l on l_orderkey = o_orderkey where n <> m",
)
def size_mismatch(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey").where("n <> m")


@query("names_except", "select l_returnflag || l_linestatus as name from lineitem except select 'A' || l_linestatus from lineitem")
def names_except(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("name")).subtract(rows.select(F.concat(F.lit("A"), "l_linestatus")))


@query("first_file", "select source, arg_min(doc_id, md5(doc_id::varchar)) as doc_id from documents group by 1")
def first_file(spark, d):
    return cat.first_match(table(spark, d, "documents").withColumn("order", F.md5(F.col("doc_id").cast("string"))), ["source"], "doc_id", "order")


@query(
    "cache_state",
    "select event_id, cast(date_diff('day', cast(ts as date), date '2024-03-01') as int) as age_days, date_diff('day', cast(ts as date), date "
    "'2024-03-01') <= 30 as valid from events",
)
def cache_state(spark, d):
    return cat.cache_state(table(spark, d, "events").select("event_id", "ts"), F.lit("2024-03-01").cast("date"), 30).drop("ts")


@query(
    "config_rules",
    "select p_partkey, concat_ws(',', case when not p_size > 5 then 'size' end, case when not length(p_name) % 2 = 0 then 'even name' end, case "
    "when not p_retailprice < 1500 then 'price' end) as errors from part",
)
def config_rules(spark, d):
    rules = {"size": F.col("p_size") > 5, "even name": F.char_length("p_name") % 2 == 0, "price": F.col("p_retailprice") < 1500}
    return table(spark, d, "part").select("p_partkey", cat.rule_errors(rules).alias("errors"))


@query(
    "module_summary",
    "select event_type as module, count(*) as calls, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total, max(value) as most, "
    "round(avg(value), 6) as mean from events group by 1",
)
def module_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("module")).agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "running_totals",
    "select event_id, count(*) over w as calls, cast(sum(cast(round(value * 100) as bigint)) over w as bigint) as total, max(value) over w as "
    "most from events window w as (partition by user_id order by ts rows between unbounded preceding and current row)",
)
def running_totals(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("total"), F.max("value").over(w).alias("most"))


@query(
    "tensor_statistics",
    "select l_returnflag, l_linestatus, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi, round(avg(l_extendedprice), 4) as "
    "mean, round(stddev_samp(l_extendedprice), 3) as std, bool_or(isnan(l_discount)) as has_nan from lineitem group by 1, 2",
)
def tensor_statistics(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 3).alias("std"), F.bool_or(F.isnan("l_discount")).alias("has_nan"))


@query(
    "compare_columns",
    "select l_returnflag, round(avg(abs(l_quantity - l_tax * 100)), 6) as mean_error, round(max(abs(l_quantity - l_tax * 100)), 6) as max_error, "
    "round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1",
)
def compare_columns(spark, d):
    e = F.abs(F.col("l_quantity") - F.col("l_tax") * 100)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(e), 6).alias("mean_error"), F.round(F.max(e), 6).alias("max_error"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(
    "top_modules",
    "select source, total from (select source, cast(sum(n_chars) as bigint) as total from documents "
    "group by 1) order by total desc, source limit 5",
)
def top_modules(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("total")).orderBy(F.desc("total"), "source").limit(5)


@query("component_blocks", "select lang, count(distinct try_cast(substr(source, 4) as int)) as blocks from documents group by 1")
def component_blocks(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.countDistinct(F.expr("try_cast(substr(source, 4) as int)")).alias("blocks"))


@query(
    "renamed_keys",
    "select doc_id, case when starts_with(source, 'src1') then 'encoder.' || substr(source, 4) when starts_with(source, 'src') then 'decoder.' "
    "|| substr(source, 4) else source end || case when n_chars % 2 = 0 then '.weight' else '.bias' end as key from documents",
)
def renamed_keys(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", F.concat(F.when(s.startswith("src1"), F.regexp_replace(s, "^src", "encoder.")).otherwise(F.regexp_replace(s, "^src", "decoder.")), F.when(F.col("n_chars") % 2 == 0, ".weight").otherwise(".bias")).alias("key"))


@query(
    "bandwidth_stages",
    "select b.bw, r.rate, cast(greatest(1, floor(b.bw * 1000 / (10 * r.rate))) as bigint) as stages "
    "from (select unnest([1.5, 3.0, 6.0, 12.0, 24.0]::double[]) as bw) b, (select unnest([75, 150]) as rate) r",
)
def bandwidth_stages(spark, d):
    """Stages of 10 bits each that fit a bandwidth in kbit/s, at each frame rate."""
    pairs = [(bw, r) for bw in (1.5, 3.0, 6.0, 12.0, 24.0) for r in (75, 150)]
    return spark.createDataFrame(pairs, "bw double, rate int").select("bw", "rate", F.greatest(F.lit(1).cast("long"), F.floor(F.col("bw") * 1000 / (10 * F.col("rate")))).alias("stages"))


_GCD = "with recursive p as (select p_partkey, p_size::bigint as a, p_partkey % 60 + 1 as b from part), g as (select p_partkey, a, b, a as x, b as y from p union all select p_partkey, a, b, y, x % y from g where y <> 0)"


@query("common_divisor", f"{_GCD} select p_partkey, x as gcd, a // x * b as lcm from g where y = 0")
def common_divisor(spark, d):
    a, b = F.col("p_size").cast("long"), F.col("p_partkey") % 60 + 1
    return table(spark, d, "part").select("p_partkey", S.gcd(a, b, 16).alias("gcd"), F.expr("p_size div 1").alias("a"), b.alias("b")).select("p_partkey", "gcd", (F.expr("a div gcd") * F.col("b")).alias("lcm"))


@query(
    "scalar_functions",
    "select event_id, round(pow(10, value / 100 / 20), 7) as gain, round(20 * log10(value), 7) as db, round(2595 * log10(1 + value / 700), 6) as "
    "mel, round(700 * (pow(10, value / 2595) - 1), 6) as hz, cast(pow(2, ceil(log2(value + 1))) as bigint) as pow2, round(1 / (1 + exp(-value / "
    "100)), 9) as sigmoid, round(value / 100 + pow(sin(0.5 * value / 100), 2) / 0.5, 8) as snake from events where value > 0",
)
def scalar_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where("value > 0").select("event_id", F.round(S.db_to_linear(v / 100), 7).alias("gain"), F.round(S.linear_to_db(v), 7).alias("db"), F.round(S.hz_to_mel(v), 6).alias("mel"), F.round(S.mel_to_hz(v), 6).alias("hz"), S.next_power_of_two(v + 1).alias("pow2"), F.round(S.activation("sigmoid", v / 100), 9).alias("sigmoid"), F.round(S.snake(v / 100, F.lit(0.5)), 8).alias("snake"))


@query(
    "activations",
    "with e as (select event_id, (value - 245) / 100 as x from events), "
    "f as (select *, sign(x) * (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * "
    "x)) as erf from (select *, 1 / (1 + 0.3275911 * abs(x)) as t from e)) "
    "select event_id, round(greatest(x, 0), 6) as relu, round(case when x > 0 then x else 0.01 * x end, 6) as leaky, round(case when x > 0 then "
    "x else exp(x) - 1 end, 9) as elu, round(erf, 8) as erf from f",
)
def activations(spark, d):
    x = F.col("x")
    rows = table(spark, d, "events").select("event_id", ((F.col("value") - 245) / 100).alias("x"))
    return rows.select("event_id", F.round(S.activation("relu", x), 6).alias("relu"), F.round(S.activation("leaky_relu", x), 6).alias("leaky"), F.round(S.activation("elu", x), 9).alias("elu"), F.round(S.erf(x), 8).alias("erf"))


@query("big_endian_round_trip", "select o_orderkey, lpad(lower(hex(o_orderkey % 100000)), 8, '0') as bytes, o_orderkey % 100000 as value from orders")
def big_endian_round_trip(spark, d):
    b = S.int32_be_bytes(F.col("o_orderkey") % 100000)
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(b)).alias("bytes"), S.int32_be(b).alias("value"))


@query(
    "session_windows",
    "with e as (select user_id, ts as t from events), "
    "s as (select *, case when t - lag(t) over (partition by user_id order by t) < interval 6 hours then 0 else 1 end as new from e), "
    "g as (select *, sum(new) over (partition by user_id order by t) as k from s) "
    "select user_id, cast(floor(epoch(min(t))) as bigint) as start_s, count(*) as n from g group by user_id, k",
)
def session_windows(spark, d):
    """Sessions end six hours after their last event."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min(F.unix_seconds("ts")).alias("start_s"), F.count("*").alias("n")).select("user_id", "start_s", "n")


@query(
    "hopping_windows",
    "select event_type, w * 43200 as start_s, count(*) as n "
    "from (select event_type, unnest(range(cast(floor(epoch(ts) / 43200) - 1 as bigint), cast(floor(epoch(ts) / 43200) + 1 as bigint))) as w "
    "from events) group by 1, 2",
)
def hopping_windows(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("event_type", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("w.start").alias("start_s"), "n")


@query("common_names", "select c_custkey as name from customer intersect select o_custkey from orders")
def common_names(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("name")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("union_all", "select user_id as id, value from events union all select c_custkey, c_acctbal from customer")
def union_all(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "value").unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))


@query("anomalies", "select user_id, round(stddev_samp(value / 10), 6) as std from events group by 1 having stddev_samp(value / 10) > 5")
def anomalies(spark, d):
    """Modules whose output spreads by more than five, or isn't a number."""
    return cat.anomalies(table(spark, d, "events").select("user_id", (F.col("value") / 10).alias("x")), "user_id", "x").withColumn("std", F.round("std", 6))


_HEADS = ["8002", "504B0304", "", "00", "8004"]
_FILES = "f as (select page_id, case page_id % 5 " + " ".join(f"when {i} then unhex('{h}')" for i, h in enumerate(_HEADS)) + " end || encode(case when page_id % 2 = 0 then html else 'layer7' end) as content from pages)"


def files(spark, d):
    """Pages as files of several kinds: with a pickle's, a zip archive's, no or another head."""
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("page_id") % 5).cast("int")))
    return table(spark, d, "pages").select("page_id", F.concat(head, F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("layer7").cast("binary")).alias("content"))


@query(
    "sniffed_types",
    f"with {_FILES} "
    "select page_id, case when octet_length(content) < 8 then 'unknown' when starts_with(hex(content), '8002') then 'pytorch' when "
    "starts_with(hex(content), '504B') then 'zip' when starts_with(hex(content), '3C21444F4354595045') then 'page' else 'text' end as type from f",
)
def sniffed_types(spark, d):
    return files(spark, d).select("page_id", cat.sniff(F.col("content"), F.lit("x.txt")).alias("type"))


@query(
    "model_files",
    f"with {_FILES} "
    "select page_id, octet_length(content) >= 8 and (starts_with(hex(content), '8002') or starts_with(hex(content), '504B')) as model, "
    "starts_with(hex(content), '80') and (contains(substr(hex(content), 5, 2048), hex(encode('layer7'))) or contains(substr(hex(content), 5, "
    "2048), hex(encode('weight')))) as state from f",
)
def model_files(spark, d):
    return files(spark, d).select("page_id", cat.has_model_signature(F.col("content")).alias("model"), cat.is_state_dict(F.col("content")).alias("state"))


@query(
    "rate_window",
    "with e as (select event_id, event_type, cast(floor(epoch(ts)) as bigint) as second from events) "
    "select event_id, count(*) over (partition by event_type order by second range between 3600 preceding and current row) as recent, recent <= "
    "5 as allowed from e",
)
def rate_window(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("second"))
    return cat.rate_window(e, "event_type", 3600, 5).select("event_id", "recent", "allowed")


@query(
    "byte_progress",
    "select doc_id, cast(sum(n_chars) over w as bigint) as done, cast(sum(n_chars) over (partition by source) as bigint) as total from documents "
    "window w as (partition by source order by doc_id rows between unbounded preceding and current row)",
)
def byte_progress(spark, d):
    return cat.running_total(table(spark, d, "documents"), "source", "doc_id", "n_chars", 64).select("doc_id", "done", "total")


@query(
    "owner_and_name",
    "with p as (select page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '[.]git$', '') as p "
    "from pages) "
    "select page_id, case when len(string_split(p, '/')) >= 3 then split_part(p, '/', 2) end as owner, case when len(string_split(p, '/')) >= 3 "
    "then split_part(p, '/', 3) end as name from p",
)
def owner_and_name(spark, d):
    return table(spark, d, "pages").select("page_id", cat.owner_and_name(F.col("url")).alias("r")).select("page_id", "r.owner", "r.name")


@query(
    "event_properties",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(cast(json_extract_string(props, '$.none') as bigint), -1) "
    "as none, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.5) as number from events",
)
def event_properties(spark, d):
    value = lambda key, default, kind: cat.metadata_value(F.col("props"), key, F.lit(default).cast(kind), kind)
    return table(spark, d, "events").select("event_id", value("k", 0, "long").alias("k"), value("none", -1, "long").alias("none"), value("k", 0.5, "double").alias("number"))


_NAMES = ["net.pt", "net.json", "config.json", "big.safetensors", "notes.txt", "tok_config.json", "big.json"]
_LISTING = "l as (select doc_id // 5 as repo, doc_id as ord, case (doc_id * 3 + doc_id // 5) % 7 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end as path from documents)"


@query(
    "config_pairs",
    f"with {_LISTING}, j as (select *, regexp_replace(path, '[.][^.]*$', '') as stem from l where ends_with(path, '.json')), "
    "m as (select repo, path as model, regexp_replace(path, '[.][^.]*$', '') as stem from l where path in ('net.pt', 'big.safetensors')), "
    "c as (select m.repo, m.model, min_by(j.path, j.ord) as config from m "
    "join j on j.repo = m.repo and (contains(j.path, 'config') or j.stem = m.stem) group by 1, 2) select m.repo, m.model, c.config from m left "
    "join c using (repo, model)",
)
def config_pairs(spark, d):
    i = F.col("doc_id")
    listing = table(spark, d, "documents").select(F.expr("doc_id div 5").alias("repo"), i.alias("ord"), F.get(F.array(*[F.lit(n) for n in _NAMES]), ((i * 3 + F.expr("doc_id div 5")) % 7).cast("int")).alias("path"))
    return cat.pair_configs(listing)


@query(
    "cache_paths",
    "select doc_id, '/cache/' || replace(lang || '/' || source, '/', '_') || '/' || case when n_chars % 3 = 0 then 'main' else 'v' || (n_chars % "
    "3) end as path from documents",
)
def cache_paths(spark, d):
    revision = F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("v"), F.col("n_chars") % 3))
    return table(spark, d, "documents").select("doc_id", cat.cache_path("/cache/", F.concat_ws("/", "lang", "source"), revision).alias("path"))


@query("shape_checks", "select p_partkey, p_size % 3 = 1 and p_partkey % 4 = 2 as fits, true as ranked, p_size = 7 as bad from part")
def shape_checks(spark, d):
    shape = F.array((F.col("p_size") % 3).cast("long"), F.col("p_size").cast("long"), F.col("p_partkey") % 4)
    values = F.array(F.col("p_retailprice"), F.when(F.col("p_size") == 7, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    return table(spark, d, "part").select("p_partkey", cat.shape_fits(shape, [1, -1, 2]).alias("fits"), cat.rank_within(shape, 1, 3).alias("ranked"), cat.has_nan_or_inf(values).alias("bad"))


@query(
    "prefix_renamed",
    "select doc_id, case when source = 'src1' then 'head' when starts_with(source, 'src') then 'body' else source end || '.' || lang || case "
    "when n_chars % 2 = 0 then '.gain' else '.bias' end as key from (select doc_id, n_chars, lang, source from documents)",
)
def prefix_renamed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("source") == "src1", "encoder.first").when(F.col("source").startswith("src"), "encoder").otherwise(F.col("source")), F.lit("."), "lang", F.when(F.col("n_chars") % 2 == 0, ".weight").otherwise(".bias")).alias("key"))
    prefixes = spark.createDataFrame([("encoder", "body"), ("encoder.first", "head")], "prefix string, new string")
    return cat.renamed(docs, "key", prefixes, {".weight": ".gain"}).select("doc_id", F.col("renamed").alias("key"))


@query(
    "tensor_texts",
    "with e as (select vec_id, unnest(range(0, 64)) as d, unnest(embedding)::double as v from embeddings) "
    "select vec_id, cast(count(*) as int) as size, round(sum(round(v, 6)), 5) + 0.0 as total from e group by 1",
)
def tensor_texts(spark, d):
    """Numbers read back from their printed form."""
    text = box.tensor_text(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(8), F.lit(8)))
    back = box.parse_tensor(text)
    return table(spark, d, "embeddings").select("vec_id", F.size(back).alias("size"), (F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 5) + 0.0).alias("total"))


@query("tensor_lines", "select 'layer_' || vec_id as name, cast(unnest(range(0, 64)) as int) as index, unnest(embedding) as value from embeddings")
def tensor_lines(spark, d):
    return box.tensor_csv(table(spark, d, "embeddings").select(F.concat(F.lit("layer."), "vec_id").alias("tensor"), F.col("embedding").alias("values")), "tensor")


@query(
    "gradient_summary",
    "with n as (select label as module, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings) "
    "select module, count(*) as steps, round(avg(norm), 8) as mean_norm, round(max(norm), 8) as max_norm from n group by 1",
)
def gradient_summary(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("module"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    return runtime.gradient_summary(rows).select("module", "steps", F.round("mean_norm", 8).alias("mean_norm"), F.round("max_norm", 8).alias("max_norm"))


@query(
    "validated_parts",
    "select p_partkey, list_filter([case when not p_size > 5 then 'size' end, case when not p_retailprice < 1500 then 'price' end], lambda x: x "
    "is not null)::varchar as errors from part",
)
def validated_parts(spark, d):
    """The rules of a registered validator."""
    rules = runtime.Registry("validator")
    rules.register("part", lambda: {"size": F.col("p_size") > 5, "price": F.col("p_retailprice") < 1500})
    out = runtime.errors_of(table(spark, d, "part"), "p_partkey", rules, "part")
    return out.withColumn("errors", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")))


@query(
    "arrival_rate",
    "select cast(floor(epoch(ts) / 86400) as bigint) * 86400 as start_s, count(*) as n, round(count(*) / 86400.0::double / 0.01, 6) as factor "
    "from events group by 1",
)
def arrival_rate(spark, d):
    out = state.arrival_rate(table(spark, d, "events"), 86400, 0.01)
    return out.select(F.unix_timestamp("start").alias("start_s"), "n", F.round("factor", 6).alias("factor"))
