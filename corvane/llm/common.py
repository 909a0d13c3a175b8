"""Helpers shared by the corpus operators: shared-folder paths, UTF-8 bytes, doc_id ranges."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one is set in local mode, and a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corvane-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the driver's JVM ends: results are lazy and may be read until then."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. The table goes with the driver."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, behind as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(docs with a long column name, table): a number for each different (doc_id, text), ascending by doc_id, nulls first.

    Only rows with equal doc_id and text have equal numbers. Where no doc_id is null or
    has several texts, the number is the doc_id and table is None; else table has
    (name, doc_id) of each number.
    """
    # 128 bits of hash tell texts apart
    id_, h0, h1, number = (fresh(docs, c) for c in ("number_id", "number_h0", "number_h1", "number"))
    h = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    pairs = docs.select(F.col("doc_id").cast("long").alias(id_), h[0].alias(h0), h[1].alias(h1))
    differ = (F.min(h0) < F.max(h0)) | (F.min(h1) < F.max(h1)) | F.col(id_).isNull()
    if not pairs.groupBy(id_).agg(differ.alias("differ")).where("differ").take(1):
        return docs.withColumn(name, F.col("doc_id").cast("long")), None
    # ids ascend from range to range and within each; stored, as they'd change if made again
    dealt = pairs.distinct().repartitionByRange(n_partitions(docs.sparkSession), id_, h0, h1).sortWithinPartitions(id_, h0, h1)
    table = stored(dealt.withColumn(number, F.monotonically_increasing_id()), "numbers")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (h[0] == F.col(h0)) & (h[1] == F.col(h1))
    rows = docs.join(table, same).drop(id_, h0, h1).withColumnRenamed(number, name)
    return rows, table.select(F.col(number).alias(name), F.col(id_).alias("doc_id"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, even where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def range_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids, ascending, that cut the rows into ranges of about the same number of rows.

    One narrow scan; the list is bounded by n. Every bound is a doc_id that occurs.
    """
    if n < 2:
        return []
    got = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n)).alias("b")).first()["b"]
    return sorted({int(x) for x in got or []})


def range_index(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are <= doc_id (null: 0), found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    all_ = F.array(*[F.lit(b).cast("long") for b in bounds])
    head = F.size(F.filter(heads, lambda b: b <= doc_id))
    inside = F.size(F.filter(F.slice(all_, (head - 1) * step + 1, F.lit(step)), lambda b: b <= doc_id))
    return F.when(doc_id.isNull() | (head == 0), F.lit(0)).otherwise((head - 1) * step + inside)


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a text, binary or list<long> column."""
    is_list = pa.types.is_list(column.type)
    sizes = pc.fill_null(pc.list_value_length(column) if is_list else pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes * 8 if is_list else sizes


def by_bytes(batches, columns: str | tuple[str, ...], limit: int):
    """Slices of Arrow batches with about limit bytes of a text, binary or list<long> column, or of several (a longer row is alone), so that a worker's memory doesn't follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(sum(_bytes_of(batch.column(c)) for c in ((columns,) if isinstance(columns, str) else columns)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """From now on the session's Arrow batches have about limit bytes at most: executors hold them outside of the heap, a text column at twice its size while it grows. A lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > limit:
        spark.conf.set(name, str(limit))


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """run (batches -> batches) with give_back() at the task's end."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole
