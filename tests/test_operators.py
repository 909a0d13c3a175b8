import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import plans
from corvane.functions import scalar as S
from corvane.operators import catalog, tokens, vectors
from corvane.operators import signal as sig
from corvane.sources import containers, wav


def signal(spark, xs, i=1):
    return spark.createDataFrame([(i, n, x) for n, x in enumerate(xs)], "signal_id long, n long, x double")


def values(df):
    return [r.x for r in df.orderBy("signal_id", "n").collect()]


def test_fir_of_impulse_is_the_taps(spark):
    assert values(sig.fir(signal(spark, [1.0] + [0.0] * 7), [0.5, 0.25, 0.125])) == [0.5, 0.25, 0.125, 0, 0, 0, 0, 0]
    assert math.isclose(sum(sig.low_pass_taps(0.1)), 1)


def test_frames_and_overlap_add_return_the_ramp(spark):
    ramp = [float(i) for i in range(16)]
    framed = sig.frames(signal(spark, ramp), 4, 2)
    assert framed.select("frame").distinct().count() == 7
    assert values(sig.overlap_add(framed, 2).withColumn("x", F.col("total") / F.col("cover"))) == ramp
    assert sig.frames(signal(spark, [1.0, 2.0]), 4, 2).count() == 0
    assert sig.frames(signal(spark, []), 4, 2).count() == 0


@pytest.mark.parametrize("mode,numpy_mode", [("constant", "constant"), ("reflect", "reflect"), ("replicate", "edge"), ("circular", "wrap")])
def test_pad(spark, mode, numpy_mode):
    x = [float(i * i) for i in range(9)]
    assert values(sig.pad(signal(spark, x), 3, 5, mode)) == np.pad(x, (3, 5), numpy_mode).tolist()


def test_spectrum_of_a_sine(spark):
    x = [math.sin(2 * math.pi * 4 * i / 64) for i in range(64)]
    rows = vectors.spectrum(spark.createDataFrame([(1, x)], "id long, x array<double>")).collect()
    mags = {r.bin: math.hypot(r.re, r.im) for r in rows}
    assert abs(mags[4] - 32) < 1e-9 and max(v for k, v in mags.items() if k != 4) < 1e-9


def test_nearest_ties_go_to_the_lowest_code(spark):
    codes = spark.createDataFrame([(0, [5, 5]), (1, [0, 0]), (2, [0, 0])], "code long, vec array<bigint>")
    rows = spark.createDataFrame([(1, [1, 0])], "id long, vec array<bigint>")
    assert vectors.nearest(rows, codes).first()["code"] == 1


def test_bits(spark):
    codes = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "stream long, pos long, code int")
    packed = tokens.pack_bits(codes, 10)
    assert [r.value for r in packed.orderBy("byte").collect()] == [0x01, 0x08, 0x30, 0x00]
    assert [r.code for r in tokens.unpack_bits(packed, 10).orderBy("pos").collect()] == [1, 2, 3]


def test_delay_pattern(spark):
    grid = spark.createDataFrame([(1, t, c, 10 * c + t) for t in range(4) for c in range(2)], "b long, t long, c int, token int")
    got = {(r.t, r.c): r.token for r in tokens.apply_delay(grid, (0, 2)).collect()}
    assert [got[t, 1] for t in range(4)] == [1026, 1026, 10, 11] and [got[t, 0] for t in range(4)] == [0, 1, 2, 3]


def test_byte_tokens(spark):
    assert spark.createDataFrame([("[S1]a[S2]",)], "t string").select(tokens.byte_tokens(F.col("t"))).first()[0] == "016102"


def test_byte_array(spark):
    texts = [None, "", "a", "\x00b", "é漢\x7f\x80ÿ", "x" * 9, "é" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", tokens.byte_array(tokens.byte_tokens(F.col("t")), 9).alias("a")).collect()}
    assert [got[i] for i in range(len(texts))] == [list((t or "").encode()[:9].ljust(9, b"\0")) for t in texts]


def test_padded_tokens_takes_every_text_once(spark, tmp_path):
    # a text used to be encoded anew for each of its bytes: these rows took minutes
    rows = [(i, 0, chr(97 + i % 26) * 700 + "é" * (i % 300)) for i in range(4000)] + [(4000, 0, None), (4001, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.monotonic()
    got = {r.conv_id: (r.checksum, r["size"]) for r in plans.queries()["padded_tokens"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60
    assert got == {i: (sum(v * (k + 1) for k, v in enumerate((t or "").encode()[:1024])), 1024) for i, _, t in rows}


def test_wildcards_and_types(spark):
    df = spark.createDataFrame([("A.PT",), ("a.pth",), (None,)], "p string")
    assert [r[0] for r in df.select(catalog.wildcard(F.col("p"), "*.pt")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(catalog.file_type(F.col("p"))).collect()] == ["pytorch", "pytorch", "unknown"]


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        S.activation("swish", F.lit(1))
    with pytest.raises(ValueError):
        vectors.taper("kaiser", 4)


def test_wav_round_trip(spark, tmp_path):
    x = np.array([[0.0, 0.5, -0.5, 1.0], [0.25, -0.25, 0.0, -1.0]])
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8))
    rows = wav.read_wav(spark, str(tmp_path)).orderBy("channel").collect()
    assert [r.channels for r in rows] == [2, 2] and np.allclose([r.x for r in rows], x, atol=1e-4)
    part = wav.read_wav(spark, str(tmp_path), 0.125, 0.25).orderBy("channel").first()
    assert len(part.x) == 2 and abs(part.x[0] - 0.5) < 1e-4
    with pytest.raises(ValueError):
        wav.decode(b"no wave at all")


def test_containers(spark):
    meta = {"m": "x", "al": 3, "nc": 2, "lm": False}
    data = containers.write_header(meta) + b"rest"
    assert containers.read_header(data) == (meta, len(data) - 4)
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"other bytes"),)], "content binary")
    got = [r[0] for r in df.select(containers.header_json(F.col("content"))).collect()]
    assert got[0].startswith('{"m":"x"') and got[1] is None
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    assert (containers.read_dump(containers.write_dump(x)) == x).all() and (containers.read_npy(containers.write_npy(x)) == x).all()
    with pytest.raises(ValueError):
        containers.write_header({"m": "x"})
