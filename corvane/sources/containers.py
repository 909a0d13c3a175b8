"""Binary containers: a JSON-headed code stream, a tensor dump, and array files of numpy's format."""

from __future__ import annotations

import io
import json
import re
import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magic, version and required keys of the code-stream header; magic of the tensor dump (fixed values).
MAGIC, VERSION, REQUIRED = b"ECDC", 0, ("m", "al", "nc", "lm")
DUMP_MAGIC = 0x1E2D3C4B
_DTYPES = ("<f4", "<f8", "<i4", "<i8")


def write_header(metadata: dict) -> bytes:
    missing = [k for k in REQUIRED if k not in metadata]
    if missing:
        raise ValueError(f"missing keys: {missing}")
    body = json.dumps(metadata, separators=(",", ":")).encode()
    return MAGIC + bytes([VERSION]) + struct.pack(">I", len(body)) + body


def read_header(data: bytes) -> tuple[dict, int]:
    """(metadata, offset of what follows)."""
    if data[:4] != MAGIC or data[4] != VERSION:
        raise ValueError("not a code stream of a known version")
    size = struct.unpack_from(">I", data, 5)[0]
    metadata = json.loads(data[9 : 9 + size])
    missing = [k for k in REQUIRED if k not in metadata]
    if missing:
        raise ValueError(f"missing keys: {missing}")
    return metadata, 9 + size


def header_json(content: Column) -> Column:
    """The header's JSON of a binary column, null where the magic or the version differs."""
    size = F.conv(F.hex(F.substring(content, 6, 4)), 16, 10).cast("int")
    good = (F.substring(content, 1, 4) == F.lit(bytearray(MAGIC))) & (F.substring(content, 5, 1) == F.lit(bytearray([VERSION])))
    return F.when(good, F.decode(F.substring(content, F.lit(10), size), "UTF-8"))


def write_dump(x: np.ndarray) -> bytes:
    kind = _DTYPES.index(x.dtype.newbyteorder("<").str)
    return struct.pack("<ii", DUMP_MAGIC, x.ndim) + np.array(x.shape, "<i8").tobytes() + bytes([kind]) + x.astype(_DTYPES[kind]).tobytes()


def read_dump(data: bytes) -> np.ndarray:
    magic, rank = struct.unpack_from("<ii", data)
    if magic != DUMP_MAGIC:
        raise ValueError("not a tensor dump")
    shape = np.frombuffer(data, "<i8", rank, 8)
    kind = data[8 + 8 * rank]
    return np.frombuffer(data, _DTYPES[kind], int(shape.prod()), 9 + 8 * rank).reshape(shape)


def write_npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def check_metadata(metadata: dict) -> list[str]:
    """What is wrong with a header's metadata: missing keys, and values of another kind than they should have."""
    kinds = {"m": str, "al": int, "nc": int, "lm": bool}
    wrong = [f"missing {k}" for k in REQUIRED if k not in metadata]
    wrong += [f"{k} is not {t.__name__}" for k, t in kinds.items() if k in metadata and (not isinstance(metadata[k], t) or t is int and isinstance(metadata[k], bool))]
    return wrong + [f"{k} is negative" for k in ("al", "nc") if isinstance(metadata.get(k), int) and metadata[k] < 0]


#: Type tags of single metadata entries (fixed values).
ENTRY_TAGS = {1: str, 2: int, 3: bool, 4: float}


def write_entry(key: str, value) -> bytes:
    """Key length (a byte), key, type tag, value: strings with their length, whole numbers and floats of four bytes in network order."""
    name = key.encode()
    if len(name) > 255:
        raise ValueError("keys have at most 255 bytes")
    tag = next((t for t, kind in ENTRY_TAGS.items() if type(value) is kind), None)
    if tag is None:
        raise ValueError(f"no entry for {type(value).__name__}")
    body = struct.pack(">i", len(value.encode())) + value.encode() if tag == 1 else struct.pack({2: ">i", 3: ">?", 4: ">f"}[tag], value)
    return bytes([len(name)]) + name + bytes([tag]) + body


def read_entry(data: bytes, at: int = 0) -> tuple[str, object, int]:
    """(key, value, offset of what follows)."""
    size = data[at]
    key, tag, at = data[at + 1 : at + 1 + size].decode(), data[at + 1 + size], at + 2 + size
    if tag == 1:
        n = struct.unpack_from(">i", data, at)[0]
        return key, data[at + 4 : at + 4 + n].decode(), at + 4 + n
    if tag not in ENTRY_TAGS:
        raise ValueError(f"unknown type tag {tag}")
    form = {2: ">i", 3: ">?", 4: ">f"}[tag]
    return key, struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)


def _string(text: str) -> bytes:
    """A string behind its length in groups of seven bits, the lowest first."""
    body = text.encode()
    n, head = len(body), b""
    while n >= 128:
        head, n = head + bytes([n & 127 | 128]), n >> 7
    return head + bytes([n]) + body


def write_codes(config: dict, codes: list[np.ndarray]) -> bytes:
    """A file of code arrays: length and text of the configuration, then each array's rank, shape, size and 32-bit codes."""
    text = json.dumps(config, separators=(",", ":"))
    out = [struct.pack("<i", len(text)), _string(text), struct.pack("<i", len(codes))]
    for c in codes:
        out += [struct.pack("<i", c.ndim), np.array(c.shape, "<i8").tobytes(), struct.pack("<i", c.size), c.astype("<i4").tobytes()]
    return b"".join(out)


def read_codes(data: bytes) -> tuple[dict, list[np.ndarray]]:
    at, size, shift = 4, 0, 0
    while True:
        size |= (data[at] & 127) << shift
        at, shift, more = at + 1, shift + 7, data[at] & 128
        if not more:
            break
    config, at = json.loads(data[at : at + size]), at + size
    n, out = struct.unpack_from("<i", data, at)[0], []
    at += 4
    for _ in range(n):
        rank = struct.unpack_from("<i", data, at)[0]
        shape = np.frombuffer(data, "<i8", rank, at + 4)
        at += 4 + 8 * rank
        size = struct.unpack_from("<i", data, at)[0]
        if size != int(shape.prod()):
            raise ValueError("size and shape of an array differ")
        out.append(np.frombuffer(data, "<i4", size, at + 4).reshape(shape))
        at += 4 + 4 * size
    return config, out


def read_code_files(files: DataFrame) -> DataFrame:
    """(path, content) of such files, as of Spark's binaryFile -> path, array, place, code."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for i, c in enumerate(read_codes(content)[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * c.size, pa.string()), pa.array([i] * c.size, pa.int32()), pa.array(np.arange(c.size), pa.int64()), pa.array(c.ravel().astype(np.int32), pa.int32())], names=["path", "array", "place", "code"])

    return files.select("path", "content").mapInArrow(run, "path string, array int, place long, code int")


def safetensors_header(content: Column) -> Column:
    """The JSON header of a safetensors file: eight bytes of length, lowest first, then the text."""
    length = F.lit(0).cast("long")
    for i in range(8):
        length = length + F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("long") * (1 << (8 * i))
    return F.decode(F.substring(content, F.lit(9), length.cast("int")), "UTF-8")


def tensor_text(values: Column, shape: Column, head: int = 200, most: int = 400, digits: int = 6) -> Column:
    """Shape and values as text; of more than `most` values the first and last `head`."""
    show = lambda a: F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}f", x)), ", ")
    long = F.size(values) > most
    body = F.when(long, F.concat(show(F.slice(values, 1, head)), F.lit(", ... "), show(F.slice(values, -head, head)))).otherwise(show(values))
    return F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), ", "), F.lit("] "), F.lit("["), body, F.lit("]"))


def parse_tensor(text: Column) -> Column:
    """The numbers between the last brackets of a tensor's text."""
    inner = F.regexp_extract(text, r"\[([^\[\]]*)\]\s*$", 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|Infinity|NaN)"), F.lit(0)), lambda x: x.cast("double"))


def tensor_csv(rows: DataFrame, name: str) -> DataFrame:
    """(index, value) lines of tensors (name, values) for a CSV or JSON writer; dots in names become underscores."""
    return rows.select(F.replace(F.col(name), F.lit("."), F.lit("_")).alias("name"), F.posexplode("values").alias("index", "value"))


#: File endings of the tensor formats (fixed values).
EXTENSIONS = {"binary": ".bin", "numpy": ".npy", "csv": ".csv", "json": ".json", "raw": ".raw"}


def extension(form: str) -> str:
    if form not in EXTENSIONS:
        raise ValueError(f"unknown format: {form}")
    return EXTENSIONS[form]


_WORD = re.compile(r"[^A-Za-z0-9_-]+")


def file_name(name: str, form: str) -> str:
    return _WORD.sub("_", name) + extension(form)
