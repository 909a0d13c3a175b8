"""Sequence packing: bounded-space online best-fit, a fixed number of open windows per partition.

Every document's ids are cut into full windows of ``size`` and a remainder. A partition
holds at most ``open_windows`` open windows; a remainder goes to the fullest one that it
fits (best fit), a new window is opened while there is room, else the fullest is emitted
and replaced. What is still open at a partition's end (at most open_windows windows) is
merged, largest first and best fit again, with those of up to ``merge_partitions``
partitions. Only the windows' numbers and how full they are take part in that: their pieces
are moved by a join, so no task ever holds more than open_windows * merge_partitions numbers
at once, and no ids go back to Python.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.llm.common import by_bytes, stored, trimmed

SIZE, OPEN_WINDOWS, MERGE_PARTITIONS = 2048, 64, 64
_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ids of merged windows lie above those of partitions.
_MERGED = 1 << 62
#: Pieces that a worker collects before it returns them, and ids where it returns those too.
ROWS, IDS = 4096, 1 << 18


def _cut(ids: np.ndarray, size: int):
    """(start, piece) of ids; a last piece shorter than size doesn't hold on to the ids before it, as it may wait in an open window."""
    for start in range(0, len(ids), size):
        piece = ids[start : start + size]
        yield start, piece if len(piece) == size or not start else piece.copy()


class OpenWindows:
    """The open windows of one partition, by best fit. A window is [room, number, pieces]."""

    def __init__(self, limit: int, size: int):
        self.limit, self.size, self.rooms, self.count = limit, size, [], 0
        self.windows: dict[int, list] = {}

    def place(self, length: int, piece) -> list | None:
        """Put a piece of fewer than size ids into a window; returns the window emitted for it, if any."""
        out = None
        i = bisect_left(self.rooms, (length, -1))
        if i < len(self.rooms):
            room, k = self.rooms.pop(i)
        else:
            if len(self.rooms) >= self.limit:
                out = self.windows.pop(self.rooms.pop(0)[1])  # the least room: the fullest
            room, k = self.size, self.count
            self.count += 1
            self.windows[k] = []
        self.windows[k].append((self.size - room, piece))
        if room == length:
            full = self.windows.pop(k)
            return full if out is None else [*out, None, *full]
        insort(self.rooms, (room - length, k))
        return out

    def rest(self) -> list[list]:
        return [self.windows[k] for _, k in self.rooms]


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int | None = 1, open_windows: int = OPEN_WINDOWS, merge_partitions: int = MERGE_PARTITIONS, with_ids: bool = False, memo_bytes: int = tokens.MEMO_BYTES, keep: bool = True, text_bytes: int = tokens.TEXT_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with with_ids.

    docs: doc_id, text (others are ignored). A null or empty text has only the end id
    (none at all, and no row, without an end id). Null doc_ids and repeated rows are
    packed as they come. memo_bytes: what a worker remembers of words; without keep, it forgets
    them and the tokenizer when a task ends. text_bytes: texts that are encoded together. sequence_id is unique, not dense; offsets are gapless from 0.
    """
    tokenizer = tokenizer or tokens.default_path()
    schema = _COLUMNS + (", ids array<int>" if with_ids else "")

    def online(batches):
        enc, part = tokens.encoder(tokenizer, memo_bytes), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], np.int32)
        opened, emitted, held, rows = OpenWindows(open_windows, size), 0, 0, []

        def emit(window, state):
            nonlocal emitted, held
            at, number = 0, (part << 32) + emitted
            emitted += 1
            for _, (d, start, ids, n) in window:
                rows.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, at, state, ids if with_ids else None))
                at += len(ids)
            held += at if with_ids else 0

        for b in by_bytes(batches, "text", text_bytes):
            flat, counts = enc.encode_many(b.column("text"))
            stops = np.cumsum(counts)
            for d, i, j in zip(b.column("doc_id").to_pylist(), (stops - counts).tolist(), stops.tolist()):
                ids = np.concatenate([flat[i:j], tail])
                n = len(ids)
                for start, part_ids in _cut(ids, size):
                    piece = (d, start, part_ids, n)
                    if n - start >= size:
                        emit([(0, piece)], 0)
                    elif done := opened.place(n - start, piece):
                        while None in done:
                            k = done.index(None)
                            emit(done[:k], 0)
                            done = done[k + 1 :]
                        emit(done, 0)
                if len(rows) >= ROWS or held >= IDS:
                    yield _batch(rows, with_ids)
                    rows, held = [], 0
        for window in opened.rest():
            emit(window, 1)
        yield _batch(rows, with_ids)
        if not keep:
            del enc
            tokens.forget()

    placed = stored(docs.select("doc_id", "text").mapInArrow(trimmed(online), f"{_COLUMNS}, open int, ids array<int>"), "packed")
    columns = [c.split()[0] for c in schema.split(", ")]
    left = placed.where("open = 1")
    windows = left.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("g", F.expr(f"shiftright(sequence_id, 32) div {merge_partitions}"))

    def merge(table: pa.Table) -> pa.Table:
        t = table.sort_by([("used", "descending"), ("sequence_id", "ascending")])
        rooms, base, count, to, shift = [], _MERGED + (int(t.column("g")[0].as_py()) << 32), 0, [], []
        for u in t.column("used").to_pylist():
            if (i := bisect_left(rooms, (u, -1))) < len(rooms):
                room, w = rooms.pop(i)
            else:
                room, w, count = size, count, count + 1
            to.append(base + w)
            shift.append(size - room)
            insort(rooms, (room - u, w))
        return pa.table({"old": t.column("sequence_id"), "to": pa.array(to, pa.int64()), "shift": pa.array(shift, pa.int64())})

    moves = windows.groupBy("g").applyInArrow(merge, "old long, to long, shift long")
    moved = left.join(moves, left["sequence_id"] == moves["old"]).withColumns({"sequence_id": F.col("to"), "offset": F.col("offset") + F.col("shift")})
    return placed.where("open = 0").select(*columns).unionAll(moved.select(*columns))


def _batch(rows: list, with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(9)]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:7]], pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.list_(pa.int32()))], names=[*names, "open", "ids"])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
