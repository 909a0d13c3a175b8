"""File, URL and table catalogue operators: routing, types, patterns, inventories, cache rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extension -> (type, label) (fixed values).
FILE_TYPES = {
    "pt": ("pytorch", "PyTorch"),
    "pth": ("pytorch", "PyTorch"),
    "ckpt": ("checkpoint", "Checkpoint"),
    "bin": ("binary", "Binary weights"),
    "safetensors": ("safetensors", "Safetensors"),
    "onnx": ("onnx", "ONNX"),
    "h5": ("keras", "Keras"),
    "json": ("config", "Configuration"),
    "yaml": ("config", "Configuration"),
    "html": ("page", "Web page"),
    "txt": ("text", "Text"),
}


def wildcard(text: Column, pattern: str) -> Column:
    """Anchored, case-insensitive match of * and ?; false for null."""
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return F.coalesce(text.rlike(f"(?is)^{rx}$"), F.lit(False))


def file_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (t, _) in FILE_TYPES.items() for x in (k, t)])
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))


def sniff(content: Column, path: Column) -> Column:
    """Type by the first bytes: too short, pickle (80 02), zip (PK), page, else by extension."""
    head = F.substring(content, 1, 2)
    return F.when(F.length(content) < 8, "unknown").when(head == F.unhex(F.lit("8002")), "pytorch").when(head == F.unhex(F.lit("504B")), "zip").when(F.upper(F.substring(content, 1, 9).cast("string")) == "<!DOCTYPE", "page").otherwise(file_type(path))


def route(source: Column) -> Column:
    """url, hub (one slash, no colon or backslash) or local."""
    slashes = F.length(source) - F.length(F.replace(source, F.lit("/"), F.lit("")))
    return F.when(source.rlike("^https?://"), "url").when((slashes == 1) & ~source.contains(":") & ~source.startswith("/"), "hub").otherwise("local")


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.join(present, key, "left_anti")


def first_match(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value that comes first in order within each group."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(value))


def cache_state(rows: DataFrame, now: Column, max_days: int) -> DataFrame:
    """Adds age_days and valid (age within max_days) to rows with ts."""
    age = F.datediff(now, F.col("ts"))
    return rows.withColumns({"age_days": age, "valid": age <= max_days})


def rate_window(rows: DataFrame, by: str, seconds: int, capacity: int | None = None) -> DataFrame:
    """Adds `recent`: rows of the same key in the seconds up to each row's `second` (whole seconds); with a capacity also `allowed`.

    Rows are counted by second first. A window spans two blocks of `seconds` at most, so
    a count goes to its own block and, as a ghost, to the next one, and a key is dealt
    out by its blocks.
    """
    counts = rows.groupBy(by, "second").agg(F.count("*").alias("hits"))
    block = F.floor(F.col("second") / seconds)
    dealt = counts.withColumn("block", F.explode(F.array(block, block + 1))).withColumn("ghost", F.col("block") != block)
    w = Window.partitionBy(by, "block").orderBy("second").rangeBetween(-seconds, 0)
    recent = dealt.withColumn("recent", F.sum("hits").over(w)).where("not ghost").select(F.col(by).alias("rate_key"), F.col("second").alias("rate_second"), "recent")
    out = rows.join(recent, rows[by].eqNullSafe(recent["rate_key"]) & (rows["second"] == recent["rate_second"])).drop("rate_key", "rate_second")
    return out if capacity is None else out.withColumn("allowed", F.col("recent") <= capacity)


def running_total(rows: DataFrame, by: str, order: str, value: str, block: int = 4096) -> DataFrame:
    """Adds `done` (running sum of value in order of a whole-number column) and `total` by key.

    In two steps, within blocks of the order and over the blocks' sums, so that a key is dealt out.
    """
    cut = rows.withColumn("block", F.floor(F.col(order) / block))
    sums = cut.groupBy(F.col(by).alias("sum_key"), F.col("block").alias("sum_block")).agg(F.sum(value).alias("s"))
    w = Window.partitionBy("sum_key").orderBy("sum_block")
    before = sums.select("sum_key", "sum_block", (F.sum("s").over(w) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("sum_key")).alias("total"))
    inside = cut.withColumn("inside", F.sum(value).over(Window.partitionBy(by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = inside.join(before, inside[by].eqNullSafe(before["sum_key"]) & (inside["block"] == before["sum_block"]))
    return joined.withColumn("done", F.col("before") + F.col("inside")).drop("block", "sum_key", "sum_block", "before", "inside")


def rule_errors(rules: dict[str, Column]) -> Column:
    """All broken rules by name, joined by commas; empty if none is."""
    return F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])), ",")


#: Types of files that hold a model (fixed values).
MODEL_TYPES = ("pytorch", "checkpoint", "binary", "safetensors", "onnx", "keras")


def is_model_type(type_: Column) -> Column:
    return F.coalesce(type_.isin(*MODEL_TYPES), F.lit(False))


def has_model_signature(content: Column) -> Column:
    """At least eight bytes that begin as a pickle (80 02) or a zip archive (PK)."""
    head = F.substring(content, 1, 2)
    return F.coalesce((F.length(content) >= 8) & ((head == F.unhex(F.lit("8002"))) | (head == F.unhex(F.lit("504B")))), F.lit(False))


#: What the first KiB of a pickled state dictionary names (fixed values).
STATE_MARKERS = (r"state_dict", r"weight", r"bias", r"running_mean", r"running_var", r"layer\d+", r"model\.", r"module\.")


def is_state_dict(content: Column) -> Column:
    """A pickle (80) whose next KiB has one of the markers."""
    text = F.decode(F.substring(content, 3, 1024), "ISO-8859-1")
    return F.coalesce((F.substring(content, 1, 1) == F.unhex(F.lit("80"))) & text.rlike("|".join(STATE_MARKERS)), F.lit(False))


def pair_configs(files: DataFrame) -> DataFrame:
    """(repo, path, ord) -> repo, model, config: each model file with the first configuration of its repository in order.

    A JSON file is a configuration of a model if "config" is in its name, or its stem is
    the model's. The former is the same for all models of a repository, the latter an
    equi-join, so no pairs are made. A model without any has a null config.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = files.select("repo", "path", "ord", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), file_type(F.col("path")).alias("kind"))
    json_files = named.where(F.lower("name").endswith(".json"))
    common = json_files.where(F.col("name").contains("config")).groupBy("repo").agg(F.min(F.struct("ord", "path")).alias("common"))
    own = json_files.groupBy("repo", "stem").agg(F.min(F.struct("ord", "path")).alias("own"))
    models = named.where(is_model_type(F.col("kind"))).join(common, "repo", "left").join(own, ["repo", "stem"], "left")
    return models.select("repo", F.col("path").alias("model"), F.least("common", "own")["path"].alias("config"))


def cache_path(root: str, model: Column, revision: Column) -> Column:
    """root/model/revision with the slashes of the model's id as underscores; the revision is main by default."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.replace(model, F.lit("/"), F.lit("_")), F.coalesce(F.nullif(revision, F.lit("")), F.lit("main")))


def owner_and_name(url: Column) -> Column:
    """struct(owner, name) of a repository's URL, without a final slash or .git; null without both."""
    path = F.regexp_replace(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/+$", ""), r"\.git$", "")
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.struct(F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("name")))


def metadata_value(meta: Column, key: str, default: Column, kind: str) -> Column:
    """meta's value of a key as `kind`; the default where it's missing or of another kind."""
    return F.coalesce(F.get_json_object(meta, f"$.{key}").try_cast(kind), default)


def shape_fits(shape: Column, wanted: list[int]) -> Column:
    """Whether an array of sizes has the wanted rank and sizes; -1 fits any."""
    fits = F.size(shape) == len(wanted)
    for i, n in enumerate(wanted):
        if n != -1:
            fits = fits & (F.get(shape, F.lit(i)) == n)
    return F.coalesce(fits, F.lit(False))


def rank_within(shape: Column, low: int, high: int) -> Column:
    return F.coalesce(F.size(shape).between(low, high), F.lit(False))


def has_nan_or_inf(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def renamed(keys: DataFrame, key: str, prefixes: DataFrame, suffixes: dict[str, str] | None = None) -> DataFrame:
    """Adds `renamed`: the longest fitting prefix (prefix, new) replaced, then the first fitting suffix.

    The prefix table is a small dimension table; keys are joined to it by their leading dotted parts.
    """
    parts = F.split(F.col(key), r"\.")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = keys.select(key).distinct().select(F.col(key).alias("whole"), F.explode(heads).alias("prefix"))
    best = each.join(F.broadcast(prefixes) if prefixes.count() <= 100_000 else prefixes, "prefix").groupBy("whole").agg(F.max_by(F.struct("prefix", "new"), F.length("prefix")).alias("b"))
    out = keys.join(best, keys[key] == best["whole"], "left").drop("whole")
    name = F.when(F.col("b").isNull(), F.col(key)).otherwise(F.concat("b.new", F.substr(F.col(key), F.length("b.prefix") + 1)))
    for old, new in (suffixes or {}).items():
        name = F.when(name.endswith(old), F.concat(F.substring(name, F.lit(1), F.length(name) - len(old)), F.lit(new))).otherwise(name)
    return out.withColumn("renamed", name).drop("b")


def anomalies(rows: DataFrame, by: str, value: str, threshold: float = 5.0) -> DataFrame:
    """by, std of the groups whose spread is over the threshold, infinite or not a number."""
    std = F.stddev_samp(value)
    return rows.groupBy(by).agg(std.alias("std")).where(F.isnan("std") | (F.abs("std") == float("inf")) | (F.col("std") > threshold))
