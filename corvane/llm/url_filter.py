"""URL filter: host/path rules first, then a listed-URL test by blocked Bloom filter and exact hash join.

The Bloom filter is a table of 256-bit blocks (block, four 64-bit words), built by a
distributed bit_or and joined on the block number; its size is bounded by
``max_blocks``, whatever the length of the list. It only decides which pages go on to
the exact join: a false positive is removed there, and a listed URL always has its bits set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
CONTRACT_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Sites listed for the registered query, in canonical form (host without www., m. or blog., then a slash).
CONTRACT_LIST = ("adult-x.example.com/", "spam-farm.example.org/", "cheap-pills.example.net/", "ads-track.example.com/", "casino-win.example.net/", "free-bets.example.net/")
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 19
#: Parts that a site's pages are dealt over where the listed keys that occur are too many to broadcast.
SALTS = 32


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path of a URL; both empty for null or without '://'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, pattern, 2)


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www., m. or blog. and without a default port, then the path without its last slashes."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"/+$", ""))


def best_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, n_blocks: int) -> dict[str, Column]:
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return {"block": F.pmod(h, F.lit(n_blocks)).cast("int")} | {f"w{i}": F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", g, F.lit(6 * i)).bitwiseAND(63).cast("int")) for i in range(4)}


def bloom_table(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3): at most n_blocks rows of 40 bytes, from the column `key` of listed."""
    return listed.select(*[c.alias(k) for k, c in _bits(F.col("key"), n_blocks).items()]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def url_filter(pages: DataFrame, listed: DataFrame, rules=CONTRACT_RULES, max_blocks: int = MAX_BLOCKS, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages.

    pages: page_id, url (others are ignored). listed: url_key, canonical keys: a page
    is listed if its canonical URL is, or its canonical host followed by '/'. Null and
    malformed URLs have empty host and path and are allowed; null keys list nothing; a
    null page_id is kept, a URL may be of any length; repeated rows of either table are
    kept (pages) or count once (listed).
    """
    keys = listed.select(F.col("url_key").alias("key")).where("key is not null").distinct()
    n = keys.count()
    n_blocks = max(1, min(max_blocks, (n * BITS_PER_KEY + 255) // 256))
    bloom = bloom_table(keys, n_blocks)
    host, path = host_path(F.col("url"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    rows = rows.withColumn("site_key", F.concat(canonical(F.col("host"), F.lit("")), F.lit("/"))).withColumn("page_key", canonical(F.col("host"), F.col("path")))
    for k in ("site", "page"):
        rows = rows.withColumns({f"{k}_{x}": c for x, c in _bits(F.col(f"{k}_key"), n_blocks).items()})
        hit = F.lit(True)
        for i in range(4):
            hit = hit & (F.col(f"b{i}").bitwiseAND(F.col(f"{k}_w{i}")) == F.col(f"{k}_w{i}"))
        table = F.broadcast(bloom.select("block", *[F.col(f"w{i}").alias(f"b{i}") for i in range(4)]))  # max_blocks * 40 bytes at most
        rows = rows.join(table, rows[f"{k}_block"] == table["block"], "left").withColumn(f"{k}_maybe", F.coalesce(hit, F.lit(False))).drop("block", "b0", "b1", "b2", "b3")
    out = ["page_id", "host", "path", "rule", "by_rule", "site_key", "page_key", "site_maybe", "page_maybe"]
    rows = rows.select(*out)
    passed = rows.where("site_maybe or page_maybe")
    exact = passed.select(F.explode(F.array(F.when(F.col("site_maybe"), F.col("site_key")), F.when(F.col("page_maybe"), F.col("page_key")))).alias("key")).where("key is not null").distinct().join(keys, "key", "left_semi")
    salts = 1 if n <= broadcast_rows else SALTS
    exact = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    exact = F.broadcast(exact) if salts == 1 else exact  # no more rows than the list has
    site, page = exact.select(F.col("key").alias("site_key"), "salt", F.lit(True).alias("site_hit")), exact.select(F.col("key").alias("page_key"), "salt", F.lit(True).alias("page_hit"))
    dealt = passed.withColumn("salt", F.pmod(F.xxhash64("page_id", "page_key"), F.lit(salts)).cast("int"))
    judged = dealt.join(site, ["site_key", "salt"], "left").join(page, ["page_key", "salt"], "left").withColumn("listed", F.coalesce("site_hit", "page_hit", F.lit(False)))
    cols = ["page_id", "host", "path", "rule", "by_rule", "listed"]
    rest = rows.where("not (site_maybe or page_maybe)").withColumn("listed", F.lit(False))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(*cols).unionAll(rest.select(*cols)).select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "listed")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of `pages`."""
    listed = spark.createDataFrame([(x,) for x in CONTRACT_LIST], "url_key string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)


def _sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(CONTRACT_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules)
    keys = ", ".join(f"'{x}'" for x in CONTRACT_LIST)
    return f"""
with u as (select page_id, coalesce(url, '') as u from pages),
s as (select page_id, case when contains(u, '://') then substr(u, instr(u, '://') + 3) else '' end as r from u),
p as (select page_id, {lower.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from s),
c as (select *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m|blog)[.]', '') as site from p)
select page_id, host, path, case {rule} end as rule,
       case {verdict} when (site || '/') in ({keys}) or (site || regexp_replace(path, '/+$', '')) in ({keys}) then 'block' else 'allow' end as verdict,
       (site || '/') in ({keys}) or (site || regexp_replace(path, '/+$', '')) in ({keys}) as listed
from c"""


OP8_SQL = _sql()
