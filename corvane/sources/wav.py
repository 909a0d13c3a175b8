"""WAV files: decoder, encoder, readers and a writer.

Each file becomes rows (path, sample_rate, channels, bits, channel, x array<double>); an
offset and a duration in seconds limit what is decoded. Samples are 16- or 32-bit PCM,
scaled by 2^15 or 2^31, or 32-bit floats. Files are read through Spark's binaryFile source, so any store
that Spark reads will do.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sample_rate int, channels int, bits int, channel int, x array<double>"
#: Format codes of whole and float samples; file endings of audio (fixed values).
PCM, FLOAT = 1, 3
AUDIO = ("wav", "flac", "mp3", "mp4")
#: Bytes at a file's start in which its chunks up to the samples are looked for.
HEAD_BYTES = 1 << 16


def header(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(sample_rate, channels, bits, format code, offset of the samples, their bytes), from a file's beginning."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            if form is None:
                break
            code, channels, rate, _, _, bits = form
            if (code, bits) not in ((PCM, 16), (PCM, 32), (FLOAT, 32)):
                raise ValueError(f"{bits} bits a sample of format {code}")
            if not channels or not rate:
                raise ValueError("no channels or no rate")
            return rate, channels, bits, code, at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no format or data chunk")


def decode(data: bytes, offset: float = 0.0, duration: float | None = None) -> tuple[int, int, int, np.ndarray]:
    """(sample_rate, channels, bits, samples by channel); raises ValueError on anything but PCM of 16 or 32 bits and 32-bit floats."""
    rate, channels, bits, code, at, size = header(data)
    body = memoryview(data)[at : at + size]
    width = bits // 8 * channels
    first = min(int(offset * rate), len(body) // width)
    count = len(body) // width - first if duration is None else min(int(duration * rate), len(body) // width - first)
    kind = "<f4" if code == FLOAT else "<i2" if bits == 16 else "<i4"
    x = np.frombuffer(body[first * width : (first + count) * width], kind).reshape(count, channels).T.astype(float)
    return rate, channels, bits, x if code == FLOAT else x / float(1 << (bits - 1))


def encode(samples: np.ndarray, rate: int, floats: bool = False) -> bytes:
    """16-bit PCM of samples by channel, cut to -1..1 and truncated toward zero; or 32-bit floats as they are."""
    x = (np.asarray(samples, "<f4") if floats else np.trunc(np.clip(samples, -1, 1) * 32767).astype("<i2")).T
    body, channels, width = x.tobytes(), x.shape[1], 4 if floats else 2
    form = struct.pack("<IHHIIHH", 16, FLOAT if floats else PCM, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + form + b"data" + struct.pack("<I", len(body)) + body


def _files(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def find_audio(spark: SparkSession, path: str, endings=AUDIO) -> DataFrame:
    """path, length, modified of the audio files under path; their content isn't read."""
    return _files(spark, path, "*").select("path", "length", F.col("modificationTime").alias("modified")).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))


def info(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, channels, bits, frames, seconds of each file, from the head of each; no sample is decoded."""

    def run(batches):
        for b in batches:
            rows = []
            for p, n, head in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("head").to_pylist()):
                rate, channels, bits, _, at, size = header(head)
                frames = min(size, n - at) // (bits // 8 * channels)
                rows.append((p, rate, channels, bits, frames, frames / rate))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "sample_rate", "channels", "bits", "frames", "seconds"])

    heads = _files(spark, path).select("path", "length", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return heads.mapInArrow(run, "path string, sample_rate int, channels int, bits int, frames long, seconds double")


def read_wav(spark: SparkSession, path: str, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """A row for each channel of each file under path."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content")):
                rate, channels, bits, x = decode(c.as_py(), offset, duration)
                rows += [(p, rate, channels, bits, k, x[k].tolist()) for k in range(channels)]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return _files(spark, path).select("path", "content").mapInArrow(run, SCHEMA)


def mono(rows: DataFrame) -> DataFrame:
    """The mean of each file's channels, as channel 0 of one."""
    by = rows.groupBy("path").agg(F.max("sample_rate").alias("sample_rate"), F.max("bits").alias("bits"), F.count("*").alias("n"), F.collect_list("x").alias("xs"))
    total = F.aggregate(F.slice("xs", 2, 1_000_000), F.get("xs", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return by.select("path", "sample_rate", F.lit(1).alias("channels"), "bits", F.lit(0).alias("channel"), F.transform(total, lambda v: v / F.col("n")).alias("x"))


def stereo(rows: DataFrame) -> DataFrame:
    """path, sample_rate, left, right; a file that hasn't two channels fails the query."""
    by = rows.groupBy("path").agg(F.max("sample_rate").alias("sample_rate"), F.max("channels").alias("channels"), F.max(F.when(F.col("channel") == 0, F.col("x"))).alias("left"), F.max(F.when(F.col("channel") == 1, F.col("x"))).alias("right"))
    checked = F.when(F.col("channels") == 2, F.col("left")).otherwise(F.raise_error(F.concat(F.lit("not two channels: "), "path")).cast("array<double>"))
    return by.select("path", "sample_rate", checked.alias("left"), "right")


def load(spark: SparkSession, path: str, rate: int | None = None, to_mono: bool = True, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """(path, channel, n, x) of the files under path: mixed to one channel, then resampled linearly to rate."""
    from corvane.operators.resampling import resample_linear

    rows = read_wav(spark, path, offset, duration)
    rows = mono(rows) if to_mono else rows
    long = rows.select("path", "sample_rate", "channel", F.posexplode("x").alias("n", "x"))
    if rate is None:
        return long.select("path", "channel", F.col("n").cast("long").alias("n"), "x")
    rates = [r["sample_rate"] for r in rows.select("sample_rate").distinct().limit(1000).collect()]
    out = None
    for source in rates:  # a plan for each rate that occurs
        part = long.where(F.col("sample_rate") == source).select(F.struct("path", "channel").alias("signal_id"), F.col("n").cast("long").alias("n"), "x")
        part = part if source == rate else resample_linear(part, source, rate)
        out = part if out is None else out.unionAll(part)
    empty = long.where("false").select("path", "channel", F.col("n").cast("long").alias("n"), "x")
    return empty if out is None else out.select("signal_id.path", "signal_id.channel", "n", "x")


def wav_bytes(rows: DataFrame, rate: int, floats: bool = False) -> DataFrame:
    """(name, channel, x array) -> name, content: a WAV file of each name's channels, in order; channels of different length fail."""

    def run(batches):
        for b in batches:
            out = []
            for channels in b.column("channels").to_pylist():
                xs = [c["x"] or [] for c in channels]
                if len({len(x) for x in xs}) > 1:
                    raise ValueError("channels of different length")
                out.append(encode(np.array(xs, float).reshape(len(xs), -1), rate, floats))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.binary())], names=["name", "content"])

    grouped = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("channel", "x"))).alias("channels"))
    return grouped.mapInArrow(run, "name string, content binary")


def save(rows: DataFrame, folder: str, rate: int, floats: bool = False) -> None:
    """Write wav_bytes as folder/name.wav through pyarrow's file systems, each by the task that made it; a task that is run again writes the same file."""

    def run(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                with target.open_output_stream(f"{base}/{name}.wav") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    wav_bytes(rows, rate, floats).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def clamped(x: Column, limit: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))
