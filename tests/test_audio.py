"""Spectra, loudness, resampling, coding, containers and host helpers against numpy or exact round trips."""

import math
import random
import struct
from dataclasses import dataclass, field

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import runtime
from corvane.operators import attention, catalog, coder, loudness, resampling, spectra, tokens, vectors
from corvane.operators import signal as sig
from corvane.sources import configs, containers, wav


def long_form(spark, signals):
    return spark.createDataFrame([(i, n, float(x)) for i, xs in signals.items() for n, x in enumerate(xs)], "signal_id long, n long, x double")


@pytest.mark.parametrize("shape", ["hann", "hamming", "blackman", "sqrt_hann"])
@pytest.mark.parametrize("match", [False, True])
def test_inverse_transform(shape, match):
    rng = np.random.default_rng(1)
    for n in (64, 65, 200, 256) if match else (3, 64, 65, 200, 256):
        x = rng.normal(size=n)
        spec = spectra.stft_array(x, 64, 16, shape, match)
        if match:
            assert len(spec) == -(-n // 16)
        back = spectra.istft_array(spec, 64, 16, n, shape, match)
        assert len(back) == n and (match or np.allclose(back, x, atol=1e-6))
        if match and n > 128:  # the two frames at either end are gone
            assert np.allclose(back[48 : n - 64], x[48 : n - 64], atol=1e-6)


def test_stft_padding():
    assert spectra.stft_padding(100, 64, 16) == (0, 0) and spectra.stft_padding(100, 64, 16, True) == (12, 24)
    with pytest.raises(ValueError):
        spectra.stft_padding(100, 64, 20, True)
    assert spectra.fft_length(512) == 512


def test_mel_filters_have_equal_area():
    weights = vectors.mel_weights(6, 257, 16000.0)
    areas = [sum(w for m, _, w in weights if m == k) for k in range(6)]
    assert max(areas) / min(areas) < 1.1


def test_bad_masks(spark):
    spec = spectra.stft(spark.createDataFrame([(1, [1.0] * 32)], "signal_id long, x array<double>"), 16, 4)
    for f in (spectra.mask_frequencies, spectra.mask_timesteps):
        with pytest.raises(ValueError):
            f(spec, 3.0, 3.0, 10.0, 9)


def test_loudness_against_numpy(spark):
    rng, rate = np.random.default_rng(2), 100
    xs = {1: rng.normal(size=700) * np.repeat([0.01, 0.5, 0.3, 0.0004, 0.2, 0.6, 0.1], 100), 2: np.zeros(300), 3: rng.normal(size=30) * 0.2}
    rows = [(i, c, n, float(v) * (1 + c)) for i, x in xs.items() for c in range(2) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "signal_id long, channel int, n long, x double")
    from corvane.operators.effects import k_weighted

    def plain(x):
        y = [k_weighted(np.array(x) * (1 + c)) for c in range(2)]
        z = [[(c[a : a + 40] ** 2).mean() for a in range(0, len(x) - 39, 10)] for c in y]
        g = np.array([a + b for a, b in zip(*z)])
        with np.errstate(divide="ignore"):
            g = g[-0.691 + 10 * np.log10(g) > -70]
        if not len(g):
            return None
        g = g[-0.691 + 10 * np.log10(g) > -0.691 + 10 * np.log10(g.mean()) - 10]
        return -0.691 + 10 * math.log10(g.mean())

    got = {r.signal_id: r.loudness for r in loudness.integrated(df, rate).collect()}
    assert abs(got[1] - plain(xs[1])) < 1e-9 and got[2] is None and got[3] is None
    floor = {r.signal_id: r.loudness for r in loudness.loudness(df, rate).collect()}
    assert floor[2] == -70.0 and abs(floor[3] - plain(np.append(xs[3], np.zeros(20)))) < 1e-9
    level = loudness.loudness(loudness.normalize(df.where("signal_id = 1"), -23.0, rate), rate).first().loudness
    assert abs(level + 23.0) < 0.05


def test_salient_excerpt_takes_the_first_loud_try(spark):
    x = [0.0001] * 400 + [0.9 * (-1) ** n for n in range(400)]
    df = spark.createDataFrame([(1, 0, n, v) for n, v in enumerate(x)], "signal_id long, channel int, n long, x double")
    rows = loudness.salient_excerpt(df, 50, 3, 100, cutoff=-20.0, tries=8).collect()
    tries = [loudness.loudness(loudness.excerpt(df, 50, 3 + t), 100).first().loudness for t in range(8)]
    assert len(rows) == 50 and {r["try"] for r in rows} == {next(t for t, v in enumerate(tries) if v > -20.0)}


def test_rational_resampling(spark):
    t = np.arange(400)
    got = resampling.resample_rational(long_form(spark, {1: np.sin(t / 10), 2: [1.0]}), 3, 2).orderBy("signal_id", "n").collect()
    y = [r.x for r in got if r.signal_id == 1]
    assert len(y) == 600 and sum(r.signal_id == 2 for r in got) == 2
    assert np.allclose(y[100:500], np.sin(np.arange(100, 500) * 2 / 3 / 10), atol=0.01)
    with pytest.raises(ValueError):
        resampling.resample_rational(long_form(spark, {1: [1.0]}), 0, 1)


def test_interpolation_and_speed(spark):
    rng = random.Random(5)
    points = sorted({rng.randrange(1000) for _ in range(40)})
    values = [rng.random() for _ in points]
    at = [rng.uniform(-50, 1050) for _ in range(200)] + [float(points[0]), float(points[-1])]
    p = spark.createDataFrame([(1, float(x), y) for x, y in zip(points, values)], "signal_id long, xp double, fp double")
    got = {r.at: r.y for r in resampling.interpolate(p, spark.createDataFrame([(1, x) for x in at], "signal_id long, at double")).collect()}
    assert all(abs(got[x] - np.interp(x, points, values)) < 1e-9 for x in at)
    fast = resampling.adjust_speed(long_form(spark, {1: range(101)}), 2.0).orderBy("n").collect()
    assert np.allclose([r.x for r in fast], np.linspace(0, 100, 50))
    for source, target, align in ((2, 3, False), (3, 2, True), (1, 5, False), (7, 3, True)):
        x = [rng.random() for _ in range(37)]
        rows = resampling.resample_linear(long_form(spark, {1: x, 2: [0.5]}), source, target, align).orderBy("signal_id", "n").collect()
        new = 37 * target // source
        pos = np.arange(new) * (36 / (new - 1) if align else source / target)
        assert np.allclose([r.x for r in rows if r.signal_id == 1], np.interp(pos, np.arange(37), x))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=200), st.lists(st.integers(1, 1000), min_size=7, max_size=7), st.integers(6, 24))
def test_arithmetic_coder(symbols, weights, bits):
    cdf = coder.stable_cdf([w / sum(weights) for w in weights], bits, least=2)
    c = coder.Coder(bits)
    for s in symbols:
        c.push(s, cdf)
    data = c.flush()
    d = coder.Decoder(data, bits)
    assert [d.pull(cdf) for _ in symbols] == symbols


def test_coder_is_near_the_entropy_and_refuses_nonsense():
    weights = [0.9, 0.05, 0.03, 0.02]
    cdf, rng = coder.stable_cdf(weights), random.Random(1)
    symbols = rng.choices(range(4), weights, k=20_000)
    c = coder.Coder()
    for s in symbols:
        c.push(s, cdf)
    entropy = -sum(w * math.log2(w) for w in weights) * len(symbols) / 8
    assert len(c.flush()) < 1.05 * entropy + 16
    assert coder.Decoder(b"").pull(cdf) is None
    for bad in (lambda: coder.Coder(31), lambda: c.push(9, cdf), lambda: coder.stable_cdf([0.5, -0.1]), lambda: coder.stable_cdf([1.0] * 5, 3), lambda: coder.stable_cdf([1.5, 1.5]), lambda: coder.pack(np.array([8]), 3), lambda: coder.unpack(b"\0", 10, 1)):
        with pytest.raises(ValueError):
            bad()


def test_quantized_cdf_raises_without_room(spark):
    counts = spark.createDataFrame([(i, 1) for i in range(9)], "symbol int, n long")
    with pytest.raises(Exception, match="fit the range"):
        tokens.quantized_cdf(counts, bits=4).collect()
    with pytest.raises(ValueError):
        tokens.quantized_cdf(counts, least=0)


def test_compressed_files_keep_scales(spark):
    rng = random.Random(6)
    rows = [(s, f, t, k, rng.randrange(1024), 0.5 * f if f % 2 else None) for s in range(3) for f in range(3) for t in range(4) for k in range(2)]
    frames = spark.createDataFrame(rows, "stream long, frame long, t long, k int, code int, scale float")
    cdf = coder.stable_cdf([1 / 1024] * 1024)
    for kind in ("packed", "arithmetic"):
        files = coder.compress(frames, 10, "model", 24000, kind, cdf)
        assert sorted(map(str, coder.decompress(files, 10, cdf).collect())) == sorted(map(str, frames.collect()))
    with pytest.raises(ValueError):
        coder.compress(frames, 10, "model", 24000, "other")


def test_code_files_and_entries(spark):
    codes = [np.arange(12).reshape(1, 3, 4), np.zeros((2, 0)), np.array([7])]
    config = {"rate": 44100, "text": "ü" * 200}
    data = containers.write_codes(config, codes)
    back, arrays = containers.read_codes(data)
    assert back == config and all((a == b).all() and a.shape == b.shape for a, b in zip(arrays, codes))
    rows = containers.read_code_files(spark.createDataFrame([("a.codes", bytearray(data))], "path string, content binary")).collect()
    assert len(rows) == 13 and max(r.code for r in rows) == 11
    entries = [("name", "wörd"), ("n", -5), ("flag", True), ("scale", 0.5)]
    blob, at = b"".join(containers.write_entry(k, v) for k, v in entries), 0
    for k, v in entries:
        key, value, at = containers.read_entry(blob, at)
        assert (key, value) == (k, v)
    with pytest.raises(ValueError):
        containers.write_entry("x", [1])
    assert containers.check_metadata({"m": 1, "al": True, "nc": -1, "lm": False}) == ["m is not str", "al is not int", "nc is negative"]


def test_safetensors_header_and_tensor_text(spark):
    head = b'{"a":{"dtype":"F32","shape":[2],"data_offsets":[0,8]}}'
    content = struct.pack("<Q", len(head)) + head + bytes(8)
    df = spark.createDataFrame([(bytearray(content), [1.5, -2.0, 1e-7] * 300)], "content binary, x array<double>")
    r = df.select(containers.safetensors_header(F.col("content")).alias("h"), containers.tensor_text(F.col("x"), F.array(F.lit(900)), head=4).alias("t")).first()
    assert r.h == head.decode() and r.t.startswith("[900] [1.500000, -2.000000") and " ... " in r.t
    assert containers.file_name("layer.0/w", "numpy") == "layer_0_w.npy"
    with pytest.raises(ValueError):
        containers.extension("xml")


def test_attention_masks_and_contraction(spark):
    rng = np.random.default_rng(4)
    x, pad = rng.normal(size=(5, 4)), [0, 0, 1, 0, 1]
    df = spark.createDataFrame([(0, i, x[i].tolist(), x[i].tolist(), x[i].tolist(), pad[i]) for i in range(5)], "seq long, pos long, q array<double>, k array<double>, v array<double>, pad int")
    for causal in (False, True):
        for padded in (False, True):
            got = {r.pos: r.y for r in attention.attend(df, causal, padded).collect()}
            for i in range(5):
                keys = [j for j in range(5) if (not causal or j <= i) and (not padded or pad[i] == pad[j])]
                w = np.exp([x[i] @ x[j] / 2 for j in keys])
                assert np.allclose(got[i], (w[:, None] * x[keys]).sum(0) / w.sum())
    a = spark.createDataFrame([(i, j, float(i + 2 * j)) for i in range(2) for j in range(3)], "i int, j int, x double")
    b = spark.createDataFrame([(j, k, float(j * k)) for j in range(3) for k in range(2)], "j int, k int, x double")
    got = {(r.i, r.k): r.x for r in attention.contract(a, b, ["j"]).collect()}
    assert got == {(i, k): sum((i + 2 * j) * (j * k) for j in range(3)) for i in range(2) for k in range(2)}
    with pytest.raises(ValueError):
        attention.contract(a, b.withColumnRenamed("k", "i"), ["j"])
    with pytest.raises(ValueError):
        attention.sinusoid(F.lit(1), 7)


def test_codebooks(spark):
    rng = random.Random(7)
    rows = [(i, [c * 1000 + rng.randrange(10), c * 1000 + rng.randrange(10)]) for i, c in enumerate([0, 1, 2] * 30)]
    df = spark.createDataFrame(rows, "id long, vec array<bigint>")
    start = spark.createDataFrame([(0, [10, 0]), (1, [900, 900]), (2, [2500, 2000])], "code long, vec array<bigint>")
    got = sorted(vectors.kmeans(df, start, 3).collect())
    assert [r["size"] for r in got] == [30, 30, 30] and [round(r["vec"][0], -3) for r in got] == [0, 1000, 2000]
    book = vectors.init_codebook(df, 5, 1, 3)
    assert book.count() == 5 and vectors.init_codebook(df, 5, 1, 3, book) is book
    assert vectors.sampled(df.limit(2), 5, 1).count() == 5
    used = spark.createDataFrame([(0, [1, 1], 9), (1, [2, 2], 0), (2, [3, 3], 1)], "code long, vec array<bigint>, size long")
    new = {r["code"]: r for r in vectors.replace_dead(used, df, 5).collect()}
    assert not new[0]["replaced"] and new[1]["replaced"] and new[2]["replaced"] and new[1]["vec"] != new[2]["vec"] and new[1]["size"] == 2.0
    large = spark.createDataFrame([(1, [2**40, 0])], "id long, vec array<bigint>")
    assert vectors.nearest(large, spark.createDataFrame([(0, [2**40 - 3, 4])], "code long, vec array<bigint>")).first()["dist"] == 25


def test_batches_and_waves(spark):
    df = long_form(spark, {1: [1, 2, 3], 2: [4]})
    assert sig.batch(df, "pad").count() == 6 and sig.batch(df, "truncate").count() == 2
    with pytest.raises(ValueError):
        sig.batch(df)
    assert sig.same(df, df.repartition(3)) and not sig.same(df, df.where("n > 0"))
    with pytest.raises(ValueError):
        sig.wave(spark, "saw", 1.0, 1.0, 10)


def test_pairs_and_rates(spark):
    files = spark.createDataFrame([(1, "net.pt", 0), (1, "notes.json", 1), (1, "net.json", 2), (1, "my_config.json", 3), (2, "a.pt", 0), (2, "b.json", 1)], "repo long, path string, ord long")
    assert {(r.repo, r.model): r.config for r in catalog.pair_configs(files).collect()} == {(1, "net.pt"): "net.json", (2, "a.pt"): None}
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.randrange(500)) for i in range(300)]
    got = catalog.rate_window(spark.createDataFrame(rows, "id long, k string, second long"), "k", 60, 20).collect()
    for r in got:
        n = sum(k == r.k and r.second - 60 <= s <= r.second for _, k, s in rows)
        assert r.recent == n and r.allowed == (n <= 20)


def test_runtime(spark):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert runtime.with_retry(flaky, 3, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        runtime.with_retry(lambda: (_ for _ in ()).throw(OSError("never")), 2, sleep=waits.append)
    with pytest.raises(TimeoutError):
        runtime.with_timeout(lambda: __import__("time").sleep(0.3), 0.02)
    assert runtime.each(range(9), lambda x: x * x) == [x * x for x in range(9)]
    assert not runtime.timed(lambda: 1 / 0).ok and runtime.timed(lambda: 5).value == 5
    registry = runtime.Registry("codec")
    registry.register("one", lambda x: x + 1)
    assert registry.create("one", 2) == 3
    for bad in (lambda: registry.register("one", int), lambda: registry.create("two")):
        with pytest.raises(runtime.EngineError):
            bad()
    log = runtime.Diagnostics(modules=frozenset({"encoder"}), clock=lambda: 1.0)
    for seconds in (1.0, 3.0):
        log.log("forward", "encoder", seconds=seconds)
        log.next_step()
    log.log("forward", "decoder", seconds=9.0)
    log.error("bad", "encoder")
    rows = runtime.module_summary(log.table(spark)).collect()
    assert [(r.module, r.calls, r.total) for r in rows] == [("encoder", 2, 4.0)]
    off = runtime.Diagnostics(enabled=False)
    off.log("x")
    assert off.lines == [] and off.table(spark).count() == 0
    runtime.register_functions(spark, {"twice": (lambda x: 2 * x, "long")})
    assert spark.sql("select twice(4)").first()[0] == 8


def test_wav_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    xs = {("a", 0): rng.uniform(-1, 1, 80), ("a", 1): rng.uniform(-1, 1, 80), ("b", 0): rng.uniform(-1, 1, 50)}
    rows = spark.createDataFrame([(k, c, x.tolist()) for (k, c), x in xs.items()], "name string, channel int, x array<double>")
    folder = f"file://{tmp_path}/out"
    for floats, tolerance in ((False, 1e-4), (True, 1e-6)):
        wav.save(rows, folder, 40, floats)
        got = {(r.path.split("/")[-1][0], r.channel): r.x for r in wav.read_wav(spark, folder).collect()}
        assert all(np.allclose(got[k], x, atol=tolerance) for k, x in xs.items())
    found = {r.path.split("/")[-1]: (r.sample_rate, r.channels, r.bits, r.frames, r.seconds) for r in wav.info(spark, folder).collect()}
    assert found == {"a.wav": (40, 2, 32, 80, 2.0), "b.wav": (40, 1, 32, 50, 1.25)}
    assert wav.find_audio(spark, folder).count() == 2 and wav.find_audio(spark, folder, ("mp3",)).count() == 0
    mono = wav.load(spark, folder, 20).where("path like '%a.wav'").orderBy("n").collect()
    assert len(mono) == 40 and abs(mono[3].x - (xs["a", 0][6] + xs["a", 1][6]) / 2) < 1e-6
    with pytest.raises(Exception, match="not two channels"):
        wav.stereo(wav.read_wav(spark, folder)).collect()
    with pytest.raises(ValueError):
        wav.decode(wav.encode(np.zeros((1, 4)), 8).replace(b"\x10\0data", b"\x18\0data"))


@dataclass
class Config:
    sample_rate: int = 44100
    name: str = "none"
    gain: float = 1.0
    causal: bool = False
    ratios: list = field(default_factory=list)


def test_configurations(spark, tmp_path):
    got = configs.parse('{"SampleRate": 24000, "gain": 2, "CAUSAL": true, "ratios": [8, 5], "other": 1}', Config)
    assert got == Config(24000, "none", 2.0, True, [8, 5]) and configs.parse(configs.dump(got), Config) == got
    for bad in ("[1]", "{", '{"sample_rate": "x"}', '{"sample_rate": true}'):
        with pytest.raises(ValueError):
            configs.parse(bad, Config)
    df = spark.createDataFrame([('{"a": 1}',), ("no",)], "j string").select(configs.parse_column(F.col("j"), "a int").alias("c"))
    assert [r.c and r.c.a for r in df.collect()] == [1, None]


def test_cache_table(spark, tmp_path):
    path, now = str(tmp_path / "cache"), F.lit("2024-03-31").cast("date")
    files = lambda rows: spark.createDataFrame(rows, "model string, revision string, path string, content binary")
    early = F.lit("2024-01-01").cast("date")
    configs.write_cache(configs.cache_entries(files([("a/b", None, "x.bin", bytearray(b"1")), ("c", "v1", "y.bin", bytearray(b"2"))]), early), path)
    configs.write_cache(configs.cache_entries(files([("c", "v1", "y.bin", bytearray(b"3")), ("c", "v1", "z.bin", bytearray(b"4"))]), now), path)
    entries = spark.read.parquet(path)
    assert {(r.model, r.revision, r.path, r.bytes) for r in entries.collect()} == {("a/b", "main", "x.bin", 1), ("c", "v1", "y.bin", 1), ("c", "v1", "z.bin", 1)}
    present = entries.where("path <> 'z.bin'").select("model", "revision", "path", F.when(F.col("path") == "y.bin", F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    assert {(r.path, r.reason) for r in configs.stale(entries, present, now).collect()} == {("x.bin", "old"), ("y.bin", "changed"), ("z.bin", "missing")}
