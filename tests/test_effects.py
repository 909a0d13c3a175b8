"""Effects against their definitions, a sample and a signal at a time."""

import math

import numpy as np
import pytest

from corvane.operators import effects, spectra


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(3)
    return {1: np.sin(np.arange(200) / 3).tolist(), 2: [], 3: None, 4: [1.0] + [0.0] * 59, 5: rng.normal(size=333).tolist(), 6: [0.7]}


@pytest.fixture(scope="module")
def packed(spark, signals):
    return spark.createDataFrame(list(signals.items()), "signal_id long, x array<double>").repartition(2)


def check(df, signals, one):
    got = {r.signal_id: r.x for r in df.collect()}
    assert got[2] == [] and got[3] is None
    for i, x in signals.items():
        if x:
            assert np.allclose(got[i], one(x), atol=1e-9), i


def plain_filter(x, b, a):
    y = []
    for n in range(len(x)):
        y.append(sum(c * x[n - j] for j, c in enumerate(b) if n >= j) - sum(c * y[n - j] for j, c in enumerate(a) if j and n >= j))
    return y


def test_iir_and_k_weighting(packed, signals):
    check(effects.iir(packed, [0.2, 0.3], [1.0, -0.5, 0.1]), signals, lambda x: plain_filter(x, [0.2, 0.3], [1.0, -0.5, 0.1]))

    def weighted(x):
        for b, a in effects.K_WEIGHTING:
            x = plain_filter(x, b, a)
        return x

    check(effects.k_weighting(packed), signals, weighted)


def test_compressor(packed, signals):
    def one(x, rate=100):
        limit, level, out = 10 ** (-10 / 20), 0.0, []
        up, down = 1 - math.exp(-1 / 2), 1 - math.exp(-1 / 5)
        for v in x:
            level += (up if abs(v) > level else down) * (abs(v) - level)
            out.append(v * 10 ** (3 / 20) * ((level / limit) ** (1 / 4 - 1) if level > limit else 1))
        return out

    check(effects.compressor(packed, -10.0, 4.0, 0.02, 0.05, 3.0, 100), signals, one)


def test_feedback_delay_has_every_echo(packed, signals):
    def one(x, d=7, feedback=0.5):
        line, out = [0.0] * d, []
        for v in x:
            late = line.pop()
            line.insert(0, v + feedback * late)
            out.append(0.6 * v + 0.4 * late)
        return out

    check(effects.feedback_delay(packed, 7, 0.5, 0.6, 0.4), signals, one)


def plain_reverb(x, room, damping, wet, dry, combs, all_passes):
    total = [0.0] * len(x)
    for d in combs:
        line, low = [0.0] * d, 0.0
        for n, v in enumerate(x):
            low = line.pop() * (1 - damping) + low * damping
            line.insert(0, v + low * 0.84 * room)
            total[n] += low
    for d in all_passes:
        line, out = [0.0] * d, []
        for v in total:
            late = line.pop()
            y = -0.5 * v + late + 0.5 * late
            line.insert(0, v + 0.5 * y)
            out.append(y)
        total = out
    return [dry * a + wet * b for a, b in zip(x, total)]


def test_reverb(packed, signals):
    args = (0.8, 0.5, 0.3, 0.7)
    check(effects.reverb(packed, *args, combs=(15, 17, 9), all_passes=(5, 4)), signals, lambda x: plain_reverb(x, *args, (15, 17, 9), (5, 4)))


def test_reverb_impulse_response(spark):
    x = [1.0] + [0.0] * 2999
    one = spark.createDataFrame([(1, x)], "signal_id long, x array<double>")
    y = effects.reverb(one, 0.8, 0.5, 1.0, 0.0).first().x
    assert np.allclose(y, plain_reverb(x, 0.8, 0.5, 1.0, 0.0, effects.COMBS, effects.ALL_PASSES), atol=1e-12)
    assert not any(y[: min(effects.COMBS)]) and y[min(effects.COMBS)] != 0


def swing(x, rate, sample_rate):
    t = np.linspace(0, len(x) / sample_rate, len(x)) if len(x) > 1 else np.zeros(1)
    return 2 * np.pi * rate * t


def test_flanger(packed, signals):
    def one(x, rate=0.5, depth=0.1, feedback=0.7, wet=0.6, sample_rate=100):
        most = int(depth * sample_rate)
        lfo, line, out = most * 0.5 * (1 + np.sin(swing(x, rate, sample_rate))), [0.0] * (most + 1), []
        for v, delay in zip(x, lfo):
            k = int(delay)
            late = line[k] * (1 - (delay - k)) + (line[k + 1] if k + 1 <= most else 0.0) * (delay - k)
            line = [v + feedback * late, *line[:-1]]
            out.append((1 - wet) * v + wet * late)
        return out

    check(effects.flanger(packed, 0.5, 0.1, 0.7, 0.6, 100), signals, one)


def test_chorus(packed, signals):
    def one(x, voices=3, sample_rate=100):
        total = np.zeros(len(x))
        for v in range(voices):
            rate, most = 0.5 + 0.2 * (v - voices // 2) / voices, int((0.2 + 0.005 * v + 0.002 + 0.003 * v / voices) * sample_rate)
            lfo, line = most * 0.5 * (1 + np.sin(swing(x, rate, sample_rate) + v * np.pi / voices)), [0.0] * (most + 1)
            for n, (s, delay) in enumerate(zip(x, lfo)):
                k = int(delay)
                total[n] += line[k] * (1 - (delay - k)) + (line[k + 1] if k + 1 <= most else 0.0) * (delay - k)
                line = [s, *line[:-1]]
        return 0.5 * np.array(x) + 0.5 * total / voices

    check(effects.chorus(packed, 3, 0.2, sample_rate=100), signals, one)


def test_phaser(packed, signals):
    def one(x, stages=3, sample_rate=100):
        lfo, y, last = 0.8 * np.sin(swing(x, 0.5, sample_rate)), list(x), 0.0
        for stage in range(stages):
            freq, out = 2.0 * (16 / 2) ** ((stage + 1) / stages), []
            for v, m in zip(y, lfo):
                alpha = math.tan(math.pi * freq * (1 + m) / sample_rate)
                last = (alpha - 1) / (alpha + 1) * (v + 0.7 * last) + last
                out.append(last)
            y = out
        return 0.3 * np.array(x) + 0.7 * np.array(y)

    check(effects.phaser(packed, 0.5, 3, 0.8, 0.7, 0.7, 100, 2.0, 16.0), signals, one)


def test_pitch_shift(packed, signals):
    check(effects.pitch_shift(packed, 0.0, 64), signals, lambda x: x)
    x = np.sin(2 * np.pi * 4 * np.arange(640) / 64)
    up = effects.pitch_shift(packed.sparkSession.createDataFrame([(1, x.tolist())], "signal_id long, x array<double>"), 12.0, 64).first().x
    spec = np.abs(spectra.stft_array(np.array(up), 64, 16))[8:-8].mean(0)
    assert spec.argmax() in (7, 8, 9)


def test_bad_parameters():
    with pytest.raises(ValueError):
        effects.feedback_delay(None, 0, 0.5, 1, 1)
