"""Token-ID output in Simple-8b: word-aligned coding with escapes and per-block offsets.

A word of 64 bits holds a 4-bit selector (top) and 60 bits of payload: selector s < 14
packs COUNTS[s] ids of WIDTHS[s] bits, first id lowest; 15 is the escape: the next word
is one raw 64-bit id. Blocks of BLOCK ids are coded apart from each other, and the block
table has each block's first word, so any block, or all of them at once, can be decoded
with vector operations.

Segment layout, little-endian: magic "S8B1", uint32 BLOCK, uint64 n_docs, uint64 n_ids,
uint64 n_blocks, uint64 n_words, int64 doc_id[n_docs], uint8 null[n_docs] (1: doc_id is
null), uint64 n_tokens[n_docs], uint64 first_word[n_blocks], uint64 word[n_words].
Segments are the rows of a Parquet table (segment_range, segment, before, n_tokens,
payload), written with Spark's commit protocol, ordered by (segment_range, segment) =
ascending doc_id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.llm.common import by_bytes, gone_at_exit, n_partitions, range_bounds, range_index, scratch, trimmed

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK = 1 << 10
#: Ids of a segment, unless one document has more.
SEGMENT_IDS = 1 << 18
_SELECTOR = np.full(int(COUNTS[0]) + 1, ESCAPE)  # by count; 0: no width is enough
_SELECTOR[COUNTS] = np.arange(len(COUNTS))
_BITS = np.array([i.bit_length() for i in range(1 << 17)], np.uint8)
_HEAD = struct.Struct("<4sIQQQQ")


def pack_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, first word of each block) of non-negative ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    most = int(COUNTS[0])
    blocks = -(-n // block)
    # each block on a row of its own, zeros behind it: they fit any width and are cut off again
    room = np.zeros((blocks, block + most), np.uint64)
    whole = n // block
    room[:whole, :block] = ids[: whole * block].reshape(whole, block)
    if n % block:
        room[whole, : n % block] = ids[whole * block :]
    flat = room.ravel()
    width = _BITS[flat] if int(flat.max()) < len(_BITS) else np.where(flat >> np.uint64(60) != 0, 64, np.ceil(np.log2(np.maximum(flat, 1).astype(np.float64) + 1)) + 1).astype(np.uint8)
    step, have, widest = np.zeros(len(flat), np.uint8), 1, width
    for count in COUNTS[::-1].tolist():  # widest: the most bits of the next `have` ids
        more = count - have
        if more > have:
            raise AssertionError("counts at most double")
        if more:
            widest = np.maximum(widest, np.append(widest[more:], np.zeros(more, np.uint8)))
            have = count
        step[widest <= 60 // count] = count
    # all blocks take their next word at once
    marked = np.zeros(len(flat), bool)
    at = np.arange(blocks) * (block + most)
    end = at + np.minimum(block, n - np.arange(blocks) * block)
    while len(at):
        marked[at] = True
        at = at + np.maximum(step[at], 1)
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    starts = np.flatnonzero(marked)
    took = step[starts]
    chosen = _SELECTOR[took]
    size = np.where(chosen == ESCAPE, 2, 1)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[at] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[at[mine] + 1] = flat[starts[mine]]
            continue
        value = np.zeros(len(mine), np.uint64)
        for j in range(COUNTS[s]):
            value |= flat[starts[mine] + j] << np.uint64(j * WIDTHS[s])
        words[at[mine]] |= value
    return words, at[np.searchsorted(starts, np.arange(blocks) * (block + most))].astype(np.uint64)


def unpack_words(words: np.ndarray, first: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The uint64 ids of pack_words' words."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)  # words that follow an escape
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        i, n, esc = 0, len(words), (selector == ESCAPE).tolist()
        while i < n:
            if esc[i]:
                raw[i + 1] = True
                i += 1
            i += 1
    heads = np.flatnonzero(~raw)
    chosen = selector[heads]
    count = np.append(COUNTS, [0, 1])[chosen]
    heads_of = np.searchsorted(heads, first.astype(np.int64))  # each block's first word
    over = np.add.reduceat(count, heads_of) - np.minimum(block, n_ids - np.arange(len(first)) * block)
    count[np.append(heads_of[1:], len(heads)) - 1] -= over  # a block's last word may be part full
    begin = np.cumsum(count) - count
    out = np.zeros(n_ids, np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[begin[mine]] = words[heads[mine] + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            here = mine[count[mine] > j]
            out[begin[here] + j] = (words[heads[here]] >> np.uint64(j * WIDTHS[s])) & mask
    return out


def write_segment(doc_ids: list, arrays: list[np.ndarray]) -> bytes:
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    words, first = pack_words(ids)
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([_HEAD.pack(b"S8B1", BLOCK, len(doc_ids), len(ids), len(first), len(words)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), np.array([len(a) for a in arrays], "<u8").tobytes(), first.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, n_tokens of each, ids uint32 of all)."""
    magic, block, n_docs, n_ids, n_blocks, n_words = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    first = np.frombuffer(data, "<u8", n_blocks, at + 17 * n_docs)
    words = np.frombuffer(data, "<u8", n_words, at + 17 * n_docs + 8 * n_blocks)
    return [None if z else int(x) for x, z in zip(doc_ids, null)], counts, unpack_words(words, first, n_ids, block).astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2) -> None:
    """Encode doc_id, text of docs (other columns are ignored) and write segments to path.

    Null and empty texts have only the end id; null doc_ids come first; equal doc_ids
    are written one after another, in the order of their texts. An empty table writes an empty one.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokens.default_path()
    n = n_partitions(spark)
    bounds = range_bounds(docs, n)
    dealt = docs.select("doc_id", "text", range_index(F.col("doc_id"), bounds).alias("r")).repartitionById(n, F.col("r")).sortWithinPartitions("r", F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches):
        enc = tokens.encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], np.int32)
        r, ids, arrays, held, before, segment = None, [], [], 0, 0, 0

        def flush():
            nonlocal ids, arrays, held, before, segment
            row = pa.RecordBatch.from_pydict({"segment_range": pa.array([r], pa.int32()), "segment": pa.array([segment], pa.int32()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([write_segment(ids, arrays)], pa.binary())})
            before, segment, ids, arrays, held = before + held, segment + 1, [], [], 0
            return row

        for b in by_bytes(batches, "text", tokens.TEXT_BYTES):
            flat, counts = enc.encode_many(b.column("text"))
            stops = np.cumsum(counts)
            for d, q, i, j in zip(b.column("doc_id").to_pylist(), b.column("r").to_pylist(), (stops - counts).tolist(), stops.tolist()):
                if q != r or held >= SEGMENT_IDS:
                    if ids:
                        yield flush()
                    if q != r:
                        r, before, segment = q, 0, 0
                got = np.concatenate([flat[i:j], tail])
                ids.append(d)
                arrays.append(got)
                held += len(got)
        if ids:
            yield flush()

    dealt.mapInArrow(trimmed(encode), "segment_range int, segment int, before long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, in any order."""
    files = spark.read.parquet(path)
    totals = sorted((x.segment_range, x.n) for x in files.groupBy("segment_range").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each range
    sums, so_far = [], 0
    for r, k in totals:
        sums.append((r, so_far))
        so_far += k
    starts = spark.createDataFrame(sums, "segment_range int, range_start long")

    def decode(batches):
        for b in batches:
            for base, before, data in zip(b.column("range_start").to_pylist(), b.column("before").to_pylist(), b.column("payload")):
                doc_ids, counts, ids = read_segment(data.as_buffer())
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(base + before + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())})

    return files.join(F.broadcast(starts), "segment_range").select("range_start", "before", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids array<long> of each document."""

    def decode(batches):
        for b in batches:
            for data in b.column("payload"):
                doc_ids, counts, ids = read_segment(data.as_buffer())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int64)))})

    return spark.read.parquet(path).select("payload").mapInArrow(decode, "doc_id long, ids array<long>")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` written as token files and read back."""
    path = scratch(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, gone_at_exit(spark, path))
