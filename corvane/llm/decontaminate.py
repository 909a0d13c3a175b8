"""Benchmark decontamination: a prefix-filtered set join with exact verification, in DataFrame functions only.

An item's windows are its runs of ``window`` words (one shorter window for a shorter
item); a document is hit where a window occurs. As a window must be contained whole, the
necessary prefix of its shingles, ordered by rarity, is the single rarest one: shingles
of the items are counted over all documents, each window is filed under its rarest
shingle, and only document positions with that shingle are looked at. The window's start
and end must lie in the document (positional and length bound), and then its words are
compared one by one.

The windows are a query set against all documents: they are joined in blocks of at most
``block_windows``, each broadcast, whatever the size of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fresh, let, lower_ascii

WINDOW, SHINGLE, BLOCK_WINDOWS = 13, 5, 50_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of digits, letters and all that isn't ASCII; none for null."""

    def inner(w: Column) -> Column:
        head = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
        tail = F.when((F.element_at(w, -1) == "") & (F.size(w) > 1), 1).otherwise(0)
        return F.slice(w, head + 1, F.size(w) - head - tail)

    return let(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), inner)


def _shingles(w: Column, size: int) -> Column:
    """A hash for each word: that of the size words from it on (of fewer at the end)."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, words (array), length, size, shingles (array of hashes): the distinct windows of each item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    wins = items.select("item", "w", F.explode(F.expr(f"sequence(1, greatest(size(w) - {window} + 1, 1))")).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words")).distinct()
    size = F.least(F.size("words"), F.lit(shingle))
    out = wins.withColumns({"length": F.size("words"), "size": size})
    parts = F.transform(F.expr("sequence(0, length - size)"), lambda k: F.coalesce(*[F.when(F.col("size") == s, F.xxhash64(*[F.get(F.col("words"), k + j) for j in range(s)])) for s in range(1, shingle + 1)]))
    return out.withColumn("shingles", parts)


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """docs (with column w) with h: null, then for each size the shingles at every word.

    It is exploded by the outer forms only: for the others the optimizer infers a filter
    on the array's size, and pushes it, with all that makes the array, down to the scan.
    """
    return docs.withColumn("h", F.concat(F.array(F.lit(None).cast("long")), *[_shingles(F.col("w"), s) for s in sizes]))


def rarest(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """windows with `key` and `offset`: the window's shingle with the fewest occurrences in docs, and its place in the window."""
    each = windows.select(F.explode("shingles").alias("key")).distinct()
    seen = _positions(docs.select("w"), sizes).select(F.explode_outer("h").alias("key")).join(F.broadcast(each), "key").groupBy("key").agg(F.count("*").alias("n"))  # each: bounded by block_windows
    one = windows.withColumn("id", F.xxhash64("item", "words")).select("*", F.posexplode("shingles").alias("offset", "key")).join(seen, "key", "left")
    best = one.groupBy("item", "words", "length", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key"), F.col("offset"))).alias("b"))
    return best.select("item", F.col("words").alias("window_words"), "length", "size", "b.key", "b.offset")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, text_hash, n_words, start, length, item: a row for each occurrence, and one with null start for each document row."""
    wins = item_windows(benchmark, window, shingle)
    count = wins.groupBy("size").count().collect()  # at most `shingle` rows
    sizes, n = sorted({r["size"] for r in count}) or [shingle], sum(r["count"] for r in count)
    blocks = max(1, -(-n // block_windows))
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("w"))
    out = None
    for k in range(blocks):
        block = wins.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else wins
        filed = F.broadcast(rarest(docs, block, sizes))
        rows = _positions(docs, sizes).select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode_outer("h").alias("p", "h"))
        # size s is the i-th of sizes: its positions follow those of the sizes before it
        base = F.coalesce(*[F.when(filed["size"] == s, F.col("n_words") * i) for i, s in enumerate(sizes)])
        start = F.col("p") - 1 - base - filed["offset"]
        same = F.slice(F.col("w"), F.greatest(start, F.lit(0)) + 1, filed["length"]) == filed["window_words"]
        found = rows.join(filed, (rows["h"] == filed["key"]) & (start >= 0) & (start + filed["length"] <= F.col("n_words")) & same, "left")
        found = found.where((F.col("p") == 0) | F.col("key").isNotNull()) if k == 0 else found.where("key is not null")
        found = found.select("doc_id", "text_hash", "n_words", start.cast("int").alias("start"), "length", "item")
        out = found if out is None else out.unionAll(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, share: int = 20) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and
    empty texts have no words and are hit by nothing; null item_ids count as one item
    named ''; null doc_ids are kept; repeated rows get a row each. contaminated:
    n_hit > 0 and share * n_hit >= n_words.
    """
    found = hits(docs, benchmark, window, shingle, block_windows)
    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b")))
    by = found.groupBy("doc_id", "text_hash", "n_words").agg(F.count_if(F.col("start").isNull()).alias("copies"), F.collect_set(span).alias("spans"), F.collect_set("item").alias("items"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["reach"], x["a"]))).alias("n"), F.greatest(acc["reach"], x["b"]).alias("reach"))
    n_hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), step, lambda acc: acc["n"].cast("long"))
    out = by.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated.

    Null and empty texts stay, as do rows with a null doc_id whose text is clean; of rows
    with an equal doc_id each is judged by its own text; an empty benchmark removes nothing.
    """
    bad_id, bad_hash = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = contamination(docs, benchmark, **kw).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad_id]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[bad_hash]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document of `documents` by `benchmark`."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, bench).drop("text_hash")


OP1_SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item, len(g) as n, array_to_string(g, ' ') as g from (select item, unnest(list_transform(range(1, greatest(len(w) - 13 + 1, 1) + 1), lambda i: list_slice(w, i, i + 12))) as g from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.g = bw.g and dw.n = bw.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
