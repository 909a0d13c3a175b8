"""Configurations as JSON, and the cache of files by model and revision as a table."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: str, kind: type):
    """A dataclass from JSON: names in any case, with or without underscores; unknown ones are left out, missing ones have their defaults; no object, or a value of another kind, raises."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"not JSON: {error}") from None
    if not isinstance(raw, dict):
        raise ValueError("a configuration is an object")
    plain = {k.replace("_", "").lower(): v for k, v in raw.items()}
    values = {}
    for f in fields(kind):
        key = f.name.replace("_", "").lower()
        if key not in plain:
            continue
        v, want = plain[key], f.type if isinstance(f.type, type) else {"int": int, "float": float, "str": str, "bool": bool}.get(f.type)
        if want is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if want and (not isinstance(v, want) or want is int and isinstance(v, bool)):
            raise ValueError(f"{f.name} is not {want.__name__}: {v!r}")
        values[f.name] = v
    return kind(**values)


def dump(config) -> str:
    """Indented JSON of a dataclass."""
    return json.dumps(asdict(config), indent=2)


def parse_column(text: Column, schema: str) -> Column:
    """The struct of a JSON column; null where it isn't an object of that schema."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def cache_entries(files: DataFrame, now: Column) -> DataFrame:
    """(model, revision, path, content) -> model, revision, path, bytes, sha256, cached_at: what a cache knows of its files."""
    return files.select("model", F.coalesce("revision", F.lit("main")).alias("revision"), "path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), now.alias("cached_at"))


def write_cache(entries: DataFrame, path: str) -> None:
    """Write entries by model and revision; only the partitions in entries are replaced."""
    entries.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("model", "revision").parquet(path)


def stale(entries: DataFrame, present: DataFrame, now: Column, max_days: int = 30) -> DataFrame:
    """model, revision, path, reason of cached files that are too old, missing, or of another content than present (model, revision, path, sha256)."""
    keys = ["model", "revision", "path"]
    joined = entries.join(present.withColumnRenamed("sha256", "found"), keys, "left")
    reason = F.when(F.datediff(now, F.col("cached_at")) > max_days, "old").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return joined.select(*keys, reason.alias("reason")).where("reason is not null")
