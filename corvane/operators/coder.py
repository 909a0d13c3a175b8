"""Entropy coding of symbol streams and the compressed container of coded frames, in Arrow groups: a coder's state runs through its stream."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.containers import read_header, write_header

RANGE_BITS = 24


class Coder:
    """Arithmetic coder: an interval [low, high] of growing precision; its common leading bits go out. Bits fill bytes from the lowest."""

    def __init__(self, range_bits: int = RANGE_BITS):
        if not 0 < range_bits <= 30:
            raise ValueError("range bits must be from 1 to 30")
        self.bits, self.low, self.high, self.top = range_bits, 0, 0, -1
        self.out: list[int] = []

    def push(self, symbol: int, cdf: list[int]) -> None:
        if not 0 <= symbol < len(cdf):
            raise ValueError(f"symbol {symbol} outside the distribution")
        while self.high - self.low + 1 < 1 << self.bits:
            self.low, self.high, self.top = self.low * 2, self.high * 2 + 1, self.top + 1
        low, high = _interval(self.high - self.low + 1, self.bits, cdf, symbol)
        if low > high:
            raise ValueError(f"symbol {symbol} has no room")
        self.low, self.high = self.low + low, self.low + high
        while self.top >= 0 and (self.low >> self.top) & 1 == (self.high >> self.top) & 1:
            bit = (self.low >> self.top) & 1
            self.low -= bit << self.top
            self.high -= bit << self.top
            self.top -= 1
            self.out.append(bit)

    def flush(self) -> bytes:
        self.out += [(self.low >> k) & 1 for k in range(self.top, -1, -1)]
        return np.packbits(np.array(self.out, np.uint8), bitorder="little").tobytes()


class Decoder:
    def __init__(self, data: bytes, range_bits: int = RANGE_BITS):
        self.source = iter(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").tolist())
        self.bits, self.low, self.high, self.now, self.top = range_bits, 0, 0, 0, -1

    def pull(self, cdf: list[int]) -> int | None:
        """The next symbol; None at the end of the stream."""
        while self.high - self.low + 1 < 1 << self.bits:
            bit = next(self.source, None)
            if bit is None:
                return None
            self.low, self.high, self.now, self.top = self.low * 2, self.high * 2 + 1, self.now * 2 + bit, self.top + 1
        delta, first, last = self.high - self.low + 1, 0, len(cdf) - 1
        while True:
            if first > last:
                raise ValueError("the stream doesn't fit its distributions")
            symbol = (first + last) // 2
            low, high = _interval(delta, self.bits, cdf, symbol)
            if self.now > self.low + high:
                first = symbol + 1
            elif self.now < self.low + low:
                last = symbol - 1
            else:
                break
        self.low, self.high = self.low + low, self.low + high
        while self.top >= 0 and (self.low >> self.top) & 1 == (self.high >> self.top) & 1:
            bit = (self.low >> self.top) & 1
            self.low, self.high, self.now, self.top = self.low - (bit << self.top), self.high - (bit << self.top), self.now - (bit << self.top), self.top - 1
        return symbol


def _interval(delta: int, bits: int, cdf: list[int], symbol: int) -> tuple[int, int]:
    """First and last place of a symbol in an interval of delta places, rounded inwards (whole numbers, so exact)."""
    low, high = (cdf[symbol - 1] if symbol else 0), cdf[symbol] - 1
    return -(-low * delta >> bits), high * delta >> bits


def stable_cdf(weights: list[float], range_bits: int = RANGE_BITS, roundoff: float = 1e-8, least: int = 2) -> list[int]:
    """Cumulative places of symbols with probabilities `weights`, each with at least `least` of 2^range_bits."""
    n = len(weights)
    total = 1 << range_bits
    if n * least > total:
        raise ValueError("too many symbols for the range")
    if min(weights) < 0 or not 0 < sum(weights):
        raise ValueError("probabilities must not be negative, nor all zero")
    alpha = least * n / total
    out, so_far = [], 0
    for w in weights:
        w = int(w / roundoff) * roundoff
        so_far += int(w * (1 - alpha) * total) + least
        out.append(so_far)
    if out[-1] > total:
        raise ValueError("probabilities sum to more than one")
    return out


def _grouped(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("stream")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("p"), F.col(value).cast("long").alias("v")))), lambda s: s["v"]).alias("symbols"))


def arithmetic_encode(codes: DataFrame, cdf: list[int], range_bits: int = RANGE_BITS) -> DataFrame:
    """(stream, pos, code) -> stream, n, data: a stream's symbols in order of pos under one distribution. An empty stream has no row."""

    def run(batches):
        for b in batches:
            data = []
            for symbols in b.column("symbols").to_pylist():
                coder = Coder(range_bits)
                for s in symbols:
                    coder.push(s, cdf)
                data.append(coder.flush())
            n = [len(s) for s in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("stream"), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["stream", "n", "data"])

    return _grouped(codes, "stream", "pos", "code").mapInArrow(run, "stream long, n long, data binary")


def arithmetic_decode(coded: DataFrame, cdf: list[int], range_bits: int = RANGE_BITS) -> DataFrame:
    """The inverse: stream, pos, code."""

    def run(batches):
        for b in batches:
            streams, places, codes = [], [], []
            for stream, n, data in zip(b.column("stream").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist()):
                decoder = Decoder(data, range_bits)
                for pos in range(n):
                    code = decoder.pull(cdf)
                    if code is None:
                        raise ValueError(f"stream {stream} ends after {pos} of {n} symbols")
                    streams.append(stream)
                    places.append(pos)
                    codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(streams, pa.int64()), pa.array(places, pa.int64()), pa.array(codes, pa.int32())], names=["stream", "pos", "code"])

    return coded.mapInArrow(run, "stream long, pos long, code int")


def pack(codes: np.ndarray, bits: int) -> bytes:
    """Codes of `bits` bits, lowest bit first."""
    codes = np.asarray(codes, np.int64)
    if len(codes) and (codes.min() < 0 or codes.max() >> bits):
        raise ValueError(f"a code has more than {bits} bits")
    return np.packbits(((codes[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits]
    if len(flat) < n * bits:
        raise ValueError("the stream ended too soon")
    return (flat.reshape(n, bits).astype(np.int64) << np.arange(bits)).sum(1)


def compress(frames: DataFrame, bits: int, model: str, sample_rate: int, coder: str = "packed", cdf: list[int] | None = None) -> DataFrame:
    """(stream, frame, t, k, code, scale) -> stream, data: a header, then each frame's scale count and scale (if not null) and its codes, time by time.

    All frames of a stream have the same number of codes a time; coder "arithmetic" codes
    them under cdf.
    """
    if coder not in ("packed", "arithmetic") or coder == "arithmetic" and not cdf:
        raise ValueError("coder is packed, or arithmetic with a distribution")
    rows = frames.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("frame", "t", "k", "code", "scale"))).alias("rows"))

    def run(batches):
        for b in batches:
            out = []
            for rows in b.column("rows").to_pylist():
                k = max(r["k"] for r in rows) + 1
                by: dict[int, list] = {}
                for r in rows:
                    by.setdefault(r["frame"], []).append(r)
                meta = {"m": model, "al": len(rows) // k, "nc": k, "lm": coder == "arithmetic", "sr": sample_rate, "fl": [len(x) // k for x in by.values()], "sc": [x[0]["scale"] is not None for x in by.values()]}
                data = [write_header(meta)]
                for x in by.values():
                    if x[0]["scale"] is not None:
                        data.append(struct.pack(">if", 1, x[0]["scale"]))
                    codes = [r["code"] for r in x]
                    if coder == "packed":
                        data.append(pack(np.array(codes), bits))
                    else:
                        c = Coder()
                        for s in codes:
                            c.push(s, cdf)
                        body = c.flush()
                        data.append(struct.pack(">i", len(body)) + body)
                out.append(b"".join(data))
            yield pa.RecordBatch.from_arrays([b.column("stream"), pa.array(out, pa.binary())], names=["stream", "data"])

    return rows.mapInArrow(run, "stream long, data binary")


def decompress(files: DataFrame, bits: int, cdf: list[int] | None = None) -> DataFrame:
    """The inverse: stream, frame, t, k, code, scale."""
    names = ["stream", "frame", "t", "k", "code", "scale"]

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for stream, data in zip(b.column("stream").to_pylist(), b.column("data").to_pylist()):
                meta, at = read_header(data)
                for frame, (length, scaled) in enumerate(zip(meta["fl"], meta["sc"])):
                    scale, n = None, length * meta["nc"]
                    if scaled:
                        count, scale = struct.unpack_from(">if", data, at)
                        if count != 1:
                            raise ValueError(f"invalid scale count: {count}")
                        at += 8
                    if meta["lm"]:
                        size = struct.unpack_from(">i", data, at)[0]
                        decoder = Decoder(data[at + 4 : at + 4 + size])
                        codes = [decoder.pull(cdf) for _ in range(n)]
                        at += 4 + size
                    else:
                        size = -(-n * bits // 8)
                        codes = unpack(data[at : at + size], bits, n).tolist()
                        at += size
                    for col, values in zip(cols, ([stream] * n, [frame] * n, [i // meta["nc"] for i in range(n)], [i % meta["nc"] for i in range(n)], codes, [scale] * n)):
                        col += values
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return files.mapInArrow(run, "stream long, frame long, t long, k int, code int, scale float")
