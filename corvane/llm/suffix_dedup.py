"""Suffix-array dedup by bucket-pointer refinement, without a global suffix array.

Every position has a bucket identifier, that of its q-gram (a 64-bit hash of q bytes).
Positions fall into buckets by it; a bucket is refined by sorting its members on the
identifiers of later offsets, and what a round finds out is used in the next one, which
only sees buckets that are still open:

0. buckets are q-grams. Of those in each window of ``length`` bytes only the least
   (rightmost in ties) stands for the window, its anchor: equal windows have equal anchors
   at equal offsets, so only windows in the same bucket can be equal, and anchors alone in
   their bucket end here;
1. the windows of an anchor are cut into PARTS runs at fixed offsets from it. All windows
   of a run share a core of bytes; buckets are split by the identifiers at the offsets
   0, q, 2q ... of the core, and again members alone in their bucket end;
2. each window by the identifiers at the offsets 0, q, 2q ... of its ``length`` bytes.
   All but the first of a bucket are repeats.

In rounds 0 and 1 members of a bucket are also sorted on the identifiers of the whole
stretch that their windows span. All but the first of equal stretches are repeats, and
that holds for all their windows, which take no part in later rounds. "First" is by
(doc_id, start). Sorted identifiers are compared as 128 bits made of those 64-bit ones.

Every round reduces within a batch before it shuffles, so a passage that a third of the
documents share is sent once for each batch. A bucket with many different stretches in a
batch is open for sure: its members are dealt out by their stretches (its home part only
gets a marker), and the next round joins what that separates. The text of runs goes along
to round 1, where the worker that settles a part makes the windows of its open runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, fresh, give_back, n_partitions, numbered, stored

LENGTH = 100
#: Bytes handled at once by one worker, few enough that the hashes of all their positions stay in its cache; a longer document is handled alone.
CHUNK = 1 << 17
#: Bytes of text that a batch is cut to; repeats within such a slice are settled without a shuffle.
SLICE = 8 << 20
#: Runs that the windows of an anchor are cut into in round 1, and groups of rows that a shuffle partition is handled in.
PARTS, FINE = 4, 16
#: Different stretches of one bucket in one batch from which they are dealt out by stretch.
HOT = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 31) - 1)


class _Powers:
    """Powers of the hash base and of its inverse, modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)
    table = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(256)], np.uint64)

    @classmethod
    def shrink(cls) -> None:
        """Forget what a very long document needed."""
        if len(cls.up) > CHUNK + 2:
            cls.up, cls.down = cls.up[: CHUNK + 2].copy(), cls.down[: CHUNK + 2].copy()

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            n = max(n, CHUNK + 1)
            cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    _Powers.reach(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_Powers.table[data] * _Powers.up[: len(data)])])


def _mix(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(32))
    v = v * np.uint64(0xD6E8FEB86659FD93)
    return v ^ (v >> np.uint64(29))


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of data[begin:end], equal for equal bytes wherever they lie."""
    return _mix((sums[end] - sums[begin]) * _Powers.down[begin])


def gram_size(length: int) -> int:
    return max(1, length * 3 // 8)


def identifiers(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two words, from the bucket identifiers at begin, begin + q, ... and end - q, which cover data[begin:end]."""
    size = end - begin
    one, two = _mix(size.astype(np.uint64) + np.uint64(1)), _mix(size.astype(np.uint64) + np.uint64(1 << 40))
    for k in range(int(-(-size.max() // q)) if len(size) else 0):
        on = k * q < size
        at = np.minimum(begin + k * q, end - q)
        got = span_hash(sums, at, at + q)
        one = np.where(on, _mix(one * np.uint64(0x9FB21C651E98DF25) + got), one)
        two = np.where(on, _mix((two ^ got) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k + 1)), two)
    return one, two


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """(document, position, first and last window start, bucket, two words of the stretch) of each anchor; positions within the document.

    data holds documents end to end, starts their beginnings.
    """
    q = gram_size(length)
    w, n = length - q + 1, len(data)
    ends = np.append(starts[1:], n)
    empty, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < length:
        return empty, empty, empty, empty, none, none, none
    sums = prefix_hash(data)
    at = np.arange(n - q + 1)
    bucket = span_hash(sums, at, at + q)
    least = (bucket & ~_LOW) | (_LOW - at.astype(np.uint64))
    have = 1
    while have * 2 <= w:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < w:
        least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
    doc = np.repeat(np.arange(len(starts)), ends - starts)[: n - length + 1]
    valid = np.flatnonzero(ends[doc] >= np.arange(n - length + 1) + length)
    if not len(valid):
        return empty, empty, empty, empty, none, none, none
    doc, anchor = doc[valid], (_LOW - (least[valid] & _LOW)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(valid)) - 1
    d, p, lo, hi = doc[new], anchor[new], valid[new], valid[last]
    one, two = identifiers(sums, lo, hi + length, q)
    two = two ^ _mix(((p - lo) * 4096 + (hi - lo)).astype(np.uint64))  # the anchor's place in it counts
    return d, p - starts[d], lo - starts[d], hi - starts[d], bucket[p], one, two


def runs_of(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH):
    """(anchor, first window start, last one, core start) of each run of the windows of anchors; a run's core is in all windows of its place, whatever the anchor has of them."""
    w = length - gram_size(length) + 1
    step = -(-w // PARTS)
    out = []
    for j in range(PARTS):
        first = at - (w - 1) + j * step
        last = np.minimum(first + step - 1, at)
        a, b = np.maximum(first, lo), np.minimum(last, hi)
        i = np.flatnonzero(a <= b)
        out.append((i, a[i], b[i], (first + step - 1)[i]))
    i, a, b, core = (np.concatenate(x) for x in zip(*out))
    return i, a, b, core, length - step + 1


def _chunks(texts: list[bytes]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _joined(texts: list[bytes]):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[:-1]


def _merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, ascending."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _firsts(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray):
    """(order, group number, is first) sorted by keys, then (doc, at). An equal (doc, at) is a repeated row: first too."""
    order = np.lexsort((at, doc, *keys[::-1]))
    same = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    same[:1] = False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, a = doc[order], at[order]
    return order, np.cumsum(~same), (d == d[head]) & (a == a[head])


_ROW = np.dtype([("bucket", "<u8"), ("key", "<u8"), ("key2", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("before", "u1"), ("more", "u1"), ("mark", "u1")])
"""A stretch: bucket, identifiers, the first window's start is at - before, `more` windows follow it."""
_SCHEMA = "part int, kind int, doc long, begin int, end int, at int, data binary"
_PARTS, _SPANS, _OPEN = 0, 1, 2


def _window_row() -> np.dtype:
    return np.dtype([("key", "<u8"), ("key2", "<u8"), ("doc", "<i8"), ("at", "<i4")])


def _run_row(length: int) -> np.dtype:
    """A run with its text; bucket2 completes the 128 bits of its core."""
    step = -(-(length - gram_size(length) + 1) // PARTS)
    return np.dtype([("bucket", "<u8"), ("bucket2", "<u8"), *[(c, _ROW[c]) for c in _ROW.names[1:]], ("text", "u1", (length + step - 1,))])


def _blob(rows: np.ndarray) -> bytes:
    """Column after column, so that what repeats lies together."""
    return b"".join([np.uint64(len(rows)).tobytes(), *[np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names]])


def _unblob(data, dtype: np.dtype) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    out, at = np.empty(n, dtype), 8
    for c in dtype.names:
        of = dtype[c].base
        size = n * dtype[c].itemsize
        out[c] = np.frombuffer(data, of, size // of.itemsize, at).reshape(out[c].shape)
        at += size
    return out


def _unblobs(column, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[_unblob(x.as_buffer(), dtype) for x in column if x.is_valid]])


_NAMES = ["part", "kind", "doc", "begin", "end", "at", "data"]


def _intervals(kind: int, doc, begin, end, at=None) -> pa.RecordBatch:
    """A row for each interval of a document."""
    n = len(doc)
    of = lambda x: pa.array(np.ascontiguousarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.ascontiguousarray(doc), pa.int64()), of(begin), of(end), pa.nulls(n, pa.int32()) if at is None else of(at), pa.nulls(n, pa.binary())], names=_NAMES)


def _send(rows: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """A row with the packed rows of each part."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    n = len(cuts)
    data = [_blob(rows[i:j]) for i, j in zip(cuts, [*cuts[1:], len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(np.full(n, _PARTS, np.int32)), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 3, pa.array(data, pa.binary())], names=_NAMES)


def _bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of stretches or runs."""
    first = rows["at"].astype(np.int64) - rows["before"]
    return first, first + rows["more"]


def _united(rows: np.ndarray, length: int) -> pa.RecordBatch:
    """What the windows of repeated stretches cover, as intervals: those of a document that touch are one."""
    lo, hi = _bounds(rows)
    if not len(rows):
        return _intervals(_SPANS, rows["doc"], lo, hi)
    docs, rank = np.unique(rows["doc"], return_inverse=True)
    begin, end = _merge((rank << 32) + lo, (rank << 32) + hi + length)
    return _intervals(_SPANS, docs[begin >> 32], begin & 0xFFFFFFFF, end & 0xFFFFFFFF)


def _runs(rows: np.ndarray, length: int) -> pa.RecordBatch:
    """Repeated windows as intervals: consecutive starts of a document are one."""
    rows = rows[np.lexsort((rows["at"], rows["doc"]))]
    if not len(rows):
        return _intervals(_SPANS, rows["doc"], rows["at"], rows["at"])
    new = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["at"][1:] > rows["at"][:-1] + 1)]))
    last = np.append(new[1:], len(rows)) - 1
    return _intervals(_SPANS, rows["doc"][new], rows["at"][new], rows["at"][last] + length)


def _begins(rows: np.ndarray, names: list[str]) -> np.ndarray:
    """Where a new bucket begins in sorted rows."""
    if not len(rows):
        return np.zeros(0, int)
    new = np.zeros(len(rows) - 1, bool)
    for c in names:
        new |= rows[c][1:] != rows[c][:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _settle(rows: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all but the first of equal stretches of a bucket, the firsts sorted by bucket and stretch, where their buckets begin)."""
    order, _, first = _firsts([*[rows[c] for c in names], rows["key"], rows["key2"]], rows["doc"], _bounds(rows)[0])
    kept = rows[order[first]]
    return rows[order[~first]], kept, _begins(kept, names)


def _deal(rows: np.ndarray, names: list[str], length: int, parts: int):
    """Of the stretches or runs of a batch: intervals of the repeats, and the rest on its way to its bucket's part."""
    again, rows, begin = _settle(rows, names)
    yield _united(again, length)
    size = np.diff(np.append(begin, len(rows)))
    hot = np.repeat(size >= HOT, size)
    rows["mark"] = hot
    marks = rows[begin[size >= HOT]].copy()
    marks["mark"] = 2
    part = np.where(hot, rows["key"], rows["bucket"]) % np.uint64(parts)
    yield _send(np.concatenate([rows, marks]), np.concatenate([part, marks["bucket"] % np.uint64(parts)]).astype(np.int64))


def _refined(rows: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, members of buckets that stay open) of the rows of a part."""
    bucket = rows["bucket"] if len(names) == 1 else rows["bucket"] ^ _mix(rows["bucket2"])
    marked = np.unique(bucket[rows["mark"] == 2])
    again, rows, begin = _settle(rows[rows["mark"] < 2], names)
    size = np.diff(np.append(begin, len(rows)))
    different = np.zeros(len(rows), bool)
    if len(rows) > 1:
        different[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["key2"][1:] != rows["key2"][:-1])
        different[begin] = False
    many = np.repeat(np.add.reduceat(different, begin, dtype=np.int64) > 0, size) if len(rows) else np.zeros(0, bool)
    bucket = rows["bucket"] if len(names) == 1 else rows["bucket"] ^ _mix(rows["bucket2"])
    return again, rows[many | (rows["mark"] == 1) | np.isin(bucket, marked)]


def _lists(column: pa.Array):
    """A tuple of arrays, one for each int field, for each row of a list<struct> column; empty for null."""
    offsets = column.offsets.to_numpy()
    fields = [column.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(column.type.value_type.num_fields)]
    for i in range(len(column)):
        a, b = (offsets[i], offsets[i + 1]) if column[i].is_valid else (0, 0)
        yield tuple(x[a:b] for x in fields)


def _by_part(df: DataFrame, parts: int, refine) -> DataFrame:
    """refine(Arrow table of one part) for the packed rows; what a batch has settled itself rides along to any part."""

    def run(table: pa.Table) -> pa.Table:
        mask = np.array(table.column("kind").to_numpy() == _PARTS)
        rest = table.filter(pa.array(~mask))
        todo = table.filter(pa.array(mask))
        return pa.concat_tables([rest, *([pa.Table.from_batches(refine(todo.column("data")))] if len(todo) else [])])

    return df.withColumn("part", F.coalesce("part", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int"))).groupBy("part").applyInArrow(run, _SCHEMA)


def _tidy() -> None:
    _Powers.shrink()
    give_back()


def repeated_spans(keyed: DataFrame, k: str, length: int = LENGTH) -> DataFrame:
    """Round 0. keyed has text and the long column k, which numbers its different documents; intervals (doc, kind, begin, end, at) are repeats, or the window starts of open anchors."""
    parts = n_partitions(keyed.sparkSession) * FINE

    def stretches(batches):
        for b in by_bytes(batches, "text", SLICE):
            ids, texts = b.column("k").to_numpy(), [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            got = []
            for start, chunk in _chunks(texts):
                d, p, lo, hi, bucket, one, two = anchors(*_joined(chunk), length)
                rows = np.zeros(len(d), _ROW)
                rows["bucket"], rows["key"], rows["key2"], rows["doc"], rows["at"], rows["before"], rows["more"] = bucket, one, two, ids[start + d], p, p - lo, hi - lo
                got.append(rows)
            yield from _deal(np.concatenate([np.zeros(0, _ROW), *got]), ["bucket"], length, parts)
        _tidy()

    def refine(data):
        again, open_ = _refined(_unblobs(data, _ROW), ["bucket"])
        lo, hi = _bounds(open_)
        return [_united(again, length), _intervals(_OPEN, open_["doc"], lo, hi, open_["at"])]

    sent = keyed.select(F.col(k).alias("k"), "text").mapInArrow(stretches, _SCHEMA)
    return stored(_by_part(sent, parts, refine).select("doc", "kind", "begin", "end", "at"), "stretches")


def _with_spans(docs: DataFrame, length: int, spans_name: str) -> DataFrame:
    """docs with the column spans_name: the repeated intervals of each row, null without any."""
    if not 2 <= length - gram_size(length) + 1 <= 256:
        raise ValueError("length must be from 3 to 408")
    n = n_partitions(docs.sparkSession)
    parts, q, row = n * FINE, gram_size(length), _run_row(length)
    k = fresh(docs, "k")
    keyed, _ = numbered(docs, k)
    first = repeated_spans(keyed, k, length)
    dealt = keyed.where(F.col(k).isNotNull()).repartition(n, k)  # no number is null; said here, both joins below read one shuffle
    opened = first.where(f"kind = {_OPEN}").groupBy(F.col("doc").alias("open_doc")).agg(F.collect_list(F.struct("begin", "end", "at")).alias("open"))

    def runs(batches):
        """Round 1, from the text of documents with open anchors."""
        for b in by_bytes(batches, "text", SLICE):
            got = []
            for doc, t, (lo, hi, at) in zip(b.column("k").to_pylist(), b.column("text").cast(pa.binary()), _lists(b.column("open"))):
                data = np.frombuffer(t.as_py() or b"", np.uint8)
                sums = prefix_hash(data)
                i, a, z, core, size = runs_of(at, lo, hi, length)
                rows = np.zeros(len(i), row)
                rows["bucket"], rows["bucket2"] = identifiers(sums, core, core + size, q)
                rows["key"], rows["key2"] = identifiers(sums, a, z + length, q)
                rows["key2"] ^= _mix(((core - a) * 4096 + (z - a)).astype(np.uint64))
                rows["doc"], rows["at"], rows["more"] = doc, a, z - a
                if len(i):
                    place = a[:, None] + np.arange(row["text"].shape[0])
                    rows["text"] = np.where(place < (z + length)[:, None], data[np.minimum(place, len(data) - 1)], 0)  # the stretch, zeros behind it
                got.append(rows)
            yield from _deal(np.concatenate([np.zeros(0, row), *got]), ["bucket", "bucket2"], length, parts)
        _tidy()

    def refine(data):
        """Round 1 of a part, then the windows of what it leaves open, from the text of open runs: in one worker, as a second one would double the memory of a task."""
        again, open_ = _refined(_unblobs(data, row), ["bucket", "bucket2"])
        return [_united(again, length), *windows(open_)]

    def windows(open_):
        for start in range(0, len(open_), CHUNK // 64):
            part = open_[start : start + CHUNK // 64]
            width = part["text"].shape[1]
            sums = prefix_hash(np.ascontiguousarray(part["text"]).ravel())
            count = part["more"].astype(np.int64) + 1
            owner = np.repeat(np.arange(len(part)), count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows = np.zeros(len(owner), _window_row())
            begin = owner * width + offset
            rows["key"], rows["key2"] = identifiers(sums, begin, begin + length, q)
            rows["doc"], rows["at"] = part["doc"][owner], part["at"][owner] + offset
            order, _, head = _firsts([rows["key"], rows["key2"]], rows["doc"], rows["at"])
            yield _runs(rows[order[~head]], length)
            rows = rows[np.sort(order[head])]
            yield _send(rows, (rows["key"] % np.uint64(parts)).astype(np.int64))

    def last(data):
        rows = _unblobs(data, _window_row())
        order, _, head = _firsts([rows["key"], rows["key2"]], rows["doc"], rows["at"])
        return [_runs(rows[order[~head]], length)]

    # with all columns, so that the shuffle of the texts is the one of the last join too
    rest = F.struct(*[c for c in dealt.columns if c not in (k, "text")] or [F.lit(0)])
    texts = dealt.join(opened, dealt[k] == opened["open_doc"]).select(F.col(k).alias("k"), "text", "open", rest.alias("rest"))
    second = _by_part(texts.mapInArrow(runs, _SCHEMA), parts, refine)
    third = _by_part(second, parts, last)
    spans = first.where(f"kind = {_SPANS}").select("doc", "begin", "end").unionAll(third.select("doc", "begin", "end")).groupBy(F.col("doc").alias("spans_doc")).agg(F.collect_list(F.struct("begin", "end")).alias(spans_name))
    return dealt.join(spans, dealt[k] == spans["spans_doc"], "left").select(*docs.columns, spans_name)


def _kept(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """(text without the intervals, bytes removed, maximal runs removed)."""
    if not len(begin):
        return text, 0, 0
    begin, end = _merge(begin, end)
    return b"".join(text[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(text)])), int((end - begin).sum()), len(begin)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    docs: doc_id, text (others are ignored). Texts are whole UTF-8 bytes, null as empty;
    texts under `length` bytes lose nothing; a null doc_id is the smallest; rows with an
    equal doc_id and text are taken as one document, so repeated rows get equal results;
    rows with an equal doc_id, or none, and other texts are documents of their own.
    """

    def cut(batches):
        for b in by_bytes(batches, "text", SLICE):
            rows = []
            for d, t, (begin, end) in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), _lists(b.column("spans"))):
                t = t.as_py() or b""
                kept, removed, runs = _kept(t, begin, end)
                rows.append((d, len(t), removed, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        _tidy()

    return _with_spans(docs.select("doc_id", "text"), length, "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns, with the repeated bytes cut out of text; the rest of a character that a cut splits goes too.

    Rows and nulls are those of docs: a null text stays null, a text may become empty.
    Documents are told apart as in dedup.
    """
    names = docs.columns
    spans = fresh(docs, "spans")

    def cut(batches):
        for b in by_bytes(batches, "text", SLICE):
            out = []
            for t, (begin, end) in zip(b.column("text").cast(pa.binary()), _lists(b.column(spans))):
                t = t.as_py()
                out.append(t if t is None else _kept(t, begin, end)[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names=names)
        _tidy()

    return _with_spans(docs, length, spans).mapInArrow(cut, docs.schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document of `documents` keeps without the bytes that 100-byte strings starting earlier cover."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
