"""Vector quantization and spectra on packed vectors.

Codebooks are small and bounded (checked) and go into the plan as one broadcast row, so
the nearest code of a vector is found without a join on the vectors' side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes times dimensions of a codebook that may be broadcast.
MAX_CODEBOOK = 4_000_000


def check_codebook(codes: DataFrame) -> DataFrame:
    """codes, which must have at most MAX_CODEBOOK numbers."""
    size = codes.agg(F.sum(F.size("vec")).alias("n")).first()["n"] or 0
    if size > MAX_CODEBOOK:
        raise ValueError(f"the codebook has {size} numbers; at most {MAX_CODEBOOK} are broadcast")
    return codes


def nearest(vectors: DataFrame, codes: DataFrame) -> DataFrame:
    """vectors (id, vec) with code, dist and residual of the nearest code (whole numbers); ties go to the lowest code.

    The codebook is bounded (checked) and goes to every task; a batch's distances to all
    codes are one matrix product. Products of whole numbers under 2^26 are exact; where
    they could be larger, exact integers are used.
    """
    import numpy as np
    import pyarrow as pa

    book = sorted((int(r["code"]), r["vec"]) for r in check_codebook(codes.select("code", "vec")).collect())  # at most MAX_CODEBOOK numbers
    names, table = np.array([c for c, _ in book], np.int64), np.array([v for _, v in book], np.int64).reshape(len(book), -1)

    def run(batches):
        for b in batches:
            n = b.num_rows
            vecs = np.array(b.column("vec").to_pylist(), np.int64).reshape(n, -1) if n else np.zeros((0, table.shape[1]), np.int64)
            most = max(int(np.abs(x).max(initial=0)) for x in (vecs, table))
            code, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
            step = max(1, (1 << 22) // max(1, len(names)))
            for k in range(0, n, step):
                part = vecs[k : k + step]
                if most * most * max(1, table.shape[1]) * 4 < 1 << 53:
                    cross = np.rint(part.astype(float) @ table.T.astype(float)).astype(np.int64)
                else:
                    cross = part @ table.T
                d = (part * part).sum(1)[:, None] + (table * table).sum(1) - 2 * cross
                best = d.argmin(1)  # the first of equal ones: the lowest code
                code[k : k + step], dist[k : k + step] = best, d[np.arange(len(part)), best]
            residual = pa.array((vecs - table[code]).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(names[code]), pa.array(dist), residual], names=["id", "vec", "code", "dist", "residual"])

    id_ = vectors.schema["id"].dataType.simpleString()
    if not book:
        raise ValueError("the codebook is empty")
    return vectors.select("id", F.col("vec").cast("array<bigint>").alias("vec")).mapInArrow(run, f"id {id_}, vec array<bigint>, code long, dist long, residual array<bigint>")


def residual_quantize(vectors: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """id, codes array, residual after the stages: each stage codes what the one before left."""
    rows = vectors.select("id", "vec", F.array().cast("array<bigint>").alias("codes"))
    for codes in stages:
        hit = nearest(rows.select(F.struct("id", "codes").alias("id"), "vec"), codes)
        rows = hit.select("id.id", F.col("residual").alias("vec"), F.concat("id.codes", F.array(F.col("code").cast("long"))).alias("codes"))
    return rows.select("id", "codes", F.col("vec").alias("residual"))


def dequantize(coded: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """Sum of the stages' code vectors: (id, codes) -> (id, vec)."""
    rows = coded
    for k, codes in enumerate(stages):
        rows = rows.join(F.broadcast(check_codebook(codes).select(F.col("code").cast("long").alias(f"c{k}"), F.col("vec").alias(f"v{k}"))), F.get("codes", F.lit(k)) == F.col(f"c{k}"), "left")
    total = F.col("v0")
    for k in range(1, len(stages)):
        total = F.zip_with(total, F.col(f"v{k}"), lambda x, y: x + y)
    return rows.select("id", total.alias("vec"))


def kmeans(vectors: DataFrame, codes: DataFrame, rounds: int) -> DataFrame:
    """(code, vec, size): Lloyd rounds from the vectors in codes; empty clusters keep their vector. Means are rounded to whole numbers (half up); sizes are those of a last assignment to the final vectors."""
    rows = vectors.select("id", "vec")
    for _ in range(rounds):
        hit = nearest(rows, codes).select("code", F.posexplode("vec").alias("d", "v"))
        mean = hit.groupBy("code", "d").agg(F.expr("cast(floor((2 * sum(v) + count(*)) / (2 * count(*))) as bigint)").alias("m"))
        new = mean.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("new"))
        codes = codes.select("code", "vec").join(new, "code", "left").select("code", F.coalesce("new", "vec").alias("vec"))
        codes = codes.sparkSession.createDataFrame(check_codebook(codes).collect(), codes.schema)  # at most MAX_CODEBOOK numbers
    size = nearest(rows, codes).groupBy("code").agg(F.count("*").alias("size"))
    return codes.select("code", "vec").join(size, "code", "left").fillna(0, ["size"])


def sampled(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """(r, id, vec): n vectors in an order drawn by seed, r from 0; each again and again if there are fewer."""
    from pyspark.sql import Window

    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    first = vectors.select("id", "vec").orderBy(order, "id").limit(n)
    ranked = first.withColumn("r", (F.row_number().over(Window.orderBy(order, "id")) - 1).cast("long"))  # n rows
    have = ranked.count()
    if not have or have >= n:
        return ranked.select("r", "id", "vec")
    times = F.sequence(F.lit(0).cast("long"), F.lit(-(-n // have) - 1).cast("long"))
    return ranked.withColumn("k", F.explode(times)).withColumn("r", F.col("r") + F.col("k") * have).where(F.col("r") < n).select("r", "id", "vec")


def init_codebook(vectors: DataFrame, n: int, rounds: int, seed: int, codes: DataFrame | None = None) -> DataFrame:
    """(code, vec, size): the codebook if there is one, else n sampled vectors after k-means rounds."""
    if codes is not None and codes.take(1):
        return codes
    return kmeans(vectors, sampled(vectors, n, seed).select(F.col("r").alias("code"), "vec"), rounds)


def replace_dead(codes: DataFrame, vectors: DataFrame, seed: int, least: float = 2.0) -> DataFrame:
    """codes (code, vec, size) with the vectors of codes under `least` replaced by sampled ones, whose sizes become `least`; replaced tells which."""
    from pyspark.sql import Window

    n = check_codebook(codes).count()
    ranked = codes.withColumn("dead", F.col("size") < least).withColumn("r", (F.row_number().over(Window.partitionBy("dead").orderBy("code")) - 1).cast("long"))
    pool = sampled(vectors, n, seed).select("r", F.col("vec").alias("new"))
    out = ranked.join(F.broadcast(pool), "r", "left")
    hit = F.col("dead") & F.col("new").isNotNull()
    return out.select("code", F.when(hit, F.col("new")).otherwise(F.col("vec")).alias("vec"), F.when(hit, F.lit(least)).otherwise(F.col("size").cast("double")).alias("size"), hit.alias("replaced"))


def embedding_sum(grid: DataFrame, tables: DataFrame) -> DataFrame:
    """(b, t, c, token) and tables (c, token, vec) -> b, t, vec: the sum of the channels' vectors; a token without one adds nothing."""
    cells = grid.join(F.broadcast(check_codebook(tables)), ["c", "token"]).select("b", "t", F.posexplode("vec").alias("d", "v"))
    return cells.groupBy("b", "t", "d").agg(F.sum("v").alias("v")).groupBy("b", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("vec"))


def ema_update(codes: DataFrame, batch: DataFrame, decay: float, eps: float = 1e-5) -> DataFrame:
    """codes (code, size, total array) moved toward a batch (code, count, sum array); adds the smoothed mean `vec`."""
    rows = codes.join(batch, "code", "left")
    zero = F.transform("total", lambda x: F.lit(0.0))
    size = decay * F.col("size") + (1 - decay) * F.coalesce("count", F.lit(0))
    total = F.zip_with("total", F.coalesce("sum", zero), lambda a, b: decay * a + (1 - decay) * b)
    rows = rows.select("code", size.alias("size"), total.alias("total"))
    whole = rows.agg(F.sum("size").alias("all"), F.count("*").alias("k"))
    smooth = (F.col("size") + eps) / (F.col("all") + F.col("k") * eps) * F.col("all")
    return rows.join(F.broadcast(whole)).withColumn("smooth", smooth).select("code", "size", "total", F.transform("total", lambda x: x / F.col("smooth")).alias("vec"))


def taper(name: str, size: int) -> list[float]:
    """Periodic window values; an unknown name raises."""
    t = [i / size for i in range(size)]
    shapes = {
        "hann": lambda x: 0.5 - 0.5 * math.cos(2 * math.pi * x),
        "hamming": lambda x: 0.54 - 0.46 * math.cos(2 * math.pi * x),
        "blackman": lambda x: 0.42 - 0.5 * math.cos(2 * math.pi * x) + 0.08 * math.cos(4 * math.pi * x),
        "bartlett": lambda x: 1 - abs(2 * x - 1),
        "sqrt_hann": lambda x: math.sqrt(0.5 - 0.5 * math.cos(2 * math.pi * x)),
        "average": lambda x: 1 / size,
        "ones": lambda x: 1.0,
    }
    if name not in shapes:
        raise ValueError(f"unknown window: {name}")
    return [shapes[name](x) for x in t]


def spectrum(frames: DataFrame, window: str = "ones") -> DataFrame:
    """(id, x array) -> (id, bin, re, im): half spectrum of each frame by numpy's real FFT in Arrow batches."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, k, re, im = [], [], [], []
            for i, x in zip(b.column("id").to_pylist(), b.column("x").to_pylist()):
                s = np.fft.rfft(np.asarray(x, float) * np.asarray(taper(window, len(x))))
                ids += [i] * len(s)
                k += range(len(s))
                re += s.real.tolist()
                im += s.imag.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k, pa.int32()), pa.array(re, pa.float64()), pa.array(im, pa.float64())], names=["id", "bin", "re", "im"])

    return frames.select("id", "x").mapInArrow(run, "id long, bin int, re double, im double")


def mel_weights(n_mels: int, bins: int, rate: float, low: float = 0.0, high: float | None = None) -> list[tuple[int, int, float]]:
    """(mel, bin, weight) of triangular filters of equal area on the HTK mel scale; zero weights are left out."""
    mel = lambda f: 2595.0 * math.log10(1 + f / 700.0)
    high = rate / 2 if high is None else high
    points = [700.0 * (10 ** ((mel(low) + (mel(high) - mel(low)) * i / (n_mels + 1)) / 2595.0) - 1) for i in range(n_mels + 2)]
    out = []
    for m in range(n_mels):
        a, c, z = points[m : m + 3]
        for k in range(bins):
            f = rate / 2 * k / (bins - 1)
            w = max(0.0, min((f - a) / (c - a), (z - f) / (z - c)))
            if w > 0:
                out.append((m, k, w * 2 / (z - a)))
    return out


def mel_spectrogram(spec: DataFrame, weights: list[tuple[int, int, float]]) -> DataFrame:
    """(id, bin, re, im) -> (id, mel, value): weighted magnitudes."""
    table = spec.sparkSession.createDataFrame(weights, "mel int, bin int, w double")
    return spec.join(F.broadcast(table), "bin").groupBy("id", "mel").agg(F.sum(F.hypot("re", "im") * F.col("w")).alias("value"))


def dct_matrix(rows: int, columns: int) -> list[tuple[int, int, float]]:
    """Orthonormal DCT-II as (k, i, weight)."""
    return [(k, i, math.sqrt((1 if k == 0 else 2) / columns) * math.cos(math.pi * k * (2 * i + 1) / (2 * columns))) for k in range(rows) for i in range(columns)]


def log_magnitude(spec: DataFrame, amin: float = 1e-5, top_db: float = 80.0) -> DataFrame:
    """(id, bin, db): 10 log10 of the power, not under the id's largest less top_db."""
    from pyspark.sql import Window

    db = 10 * F.log10(F.greatest(F.pow("re", 2) + F.pow("im", 2), F.lit(amin * amin)))
    return spec.select("id", "bin", db.alias("db")).withColumn("db", F.greatest("db", F.max("db").over(Window.partitionBy("id")) - top_db))
