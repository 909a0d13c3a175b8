"""Sequential signal effects on packed signals (signal_id, x array), in Arrow batches: what feeds its output back can't be a window.

The signals of a batch are handled together, a row of a matrix each: a time step is one
vector operation over all of them. Every effect is causal, so the zeros that fill up
shorter signals change nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: K-weighting biquads at 48 kHz: shelf, then high-pass; b, a (fixed values).
K_WEIGHTING = (
    ((1.53512485958697, -2.69169618940638, 1.19839281085285), (1.0, -1.69065929318241, 0.73248077421585)),
    ((1.0, -2.0, 1.0), (1.0, -1.99004745483398, 0.99007225036621)),
)
#: Delays in samples of the parallel combs and of the all-passes behind them (fixed values).
COMBS, ALL_PASSES = (1557, 1617, 1491, 1422, 1277, 1356, 1188, 1116), (225, 556, 441, 341)
#: Numbers of a matrix that signals are handled together in.
MATRIX = 1 << 20


def together(packed: DataFrame, f) -> DataFrame:
    """Applies f (matrix of signals x samples, lengths -> matrix) to the x of packed; null and empty ones stay as they are."""

    def run(batches):
        for b in batches:
            lists = b.column("x").to_pylist()
            full = sorted((i for i, x in enumerate(lists) if x), key=lambda i: len(lists[i]))
            out: list = list(lists)
            start = 0
            while start < len(full):
                stop = start + 1
                while stop < len(full) and (stop - start + 1) * len(lists[full[stop]]) <= MATRIX:
                    stop += 1
                group = full[start:stop]
                lengths = np.array([len(lists[i]) for i in group])
                x = np.zeros((len(group), lengths.max()))
                for row, i in enumerate(group):
                    x[row, : lengths[row]] = lists[i]
                y = f(x, lengths)
                for row, i in enumerate(group):
                    out[i] = y[row, : lengths[row]].tolist()
                start = stop
            yield pa.RecordBatch.from_arrays([b.column("signal_id"), pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "x"])

    return packed.select("signal_id", "x").mapInArrow(run, "signal_id long, x array<double>")


def lfilter(b, a, x: np.ndarray) -> np.ndarray:
    """Direct form along the last axis: a[0] y[n] = sum b[j] x[n-j] - sum a[j] y[n-j]."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    y = np.zeros(np.shape(x))
    for j, c in enumerate(b[: y.shape[-1]]):
        y[..., j:] += c * x[..., : y.shape[-1] - j]
    for n in range(1, y.shape[-1]):
        for j in range(1, min(len(a), n + 1)):
            y[..., n] -= a[j] * y[..., n - j]
    return y


def k_weighted(x: np.ndarray) -> np.ndarray:
    for b, a in K_WEIGHTING:
        x = lfilter(b, a, x)
    return x


def iir(packed: DataFrame, b, a) -> DataFrame:
    return together(packed, lambda x, _: lfilter(b, a, x))


def k_weighting(packed: DataFrame) -> DataFrame:
    return together(packed, lambda x, _: k_weighted(x))


def from_db(db: float) -> float:
    return 10 ** (db / 20)


def compressor(packed: DataFrame, threshold: float = -20.0, ratio: float = 4.0, attack: float = 0.005, release: float = 0.05, makeup: float = 0.0, sample_rate: int = 44100) -> DataFrame:
    """A level follower with attack and release in seconds; above the threshold (decibels, as makeup) the gain is (level / threshold)^(1 / ratio - 1)."""
    limit, gain = from_db(threshold), from_db(makeup)
    speed = [1 - math.exp(-1 / n) if (n := int(s * sample_rate)) else 1.0 for s in (attack, release)]

    def f(x, _):
        level, out = np.zeros(len(x)), np.empty_like(x)
        for n in range(x.shape[1]):
            size = np.abs(x[:, n])
            level = level + np.where(size > level, speed[0], speed[1]) * (size - level)
            out[:, n] = x[:, n] * gain * np.where(level > limit, (np.maximum(level, limit) / limit) ** (1 / ratio - 1), 1.0)
        return out

    return together(packed, f)


def echo(x: np.ndarray, delay: int, feedback: float) -> np.ndarray:
    """e[n] = x[n - delay] + feedback e[n - delay], a block of `delay` samples at a time."""
    out = np.zeros_like(x)
    for at in range(delay, x.shape[1], delay):
        size = min(delay, x.shape[1] - at)
        out[:, at : at + size] = x[:, at - delay : at - delay + size] + feedback * out[:, at - delay : at - delay + size]
    return out


def feedback_delay(packed: DataFrame, samples: int, feedback: float, dry: float, wet: float) -> DataFrame:
    """dry x[n] + wet times all echoes, sum_k feedback^(k-1) x[n - k samples]."""
    if samples < 1:
        raise ValueError("a delay has at least one sample")
    return together(packed, lambda x, _: dry * x + wet * echo(x, samples, feedback))


def comb(x: np.ndarray, delay: int, feedback: float, damping: float) -> np.ndarray:
    """A delay line that feeds back, and gives out, what a one-pole filter leaves of it."""
    line, low, out = np.zeros((len(x), delay)), np.zeros(len(x)), np.empty_like(x)
    for n in range(x.shape[1]):
        low = line[:, n % delay] * (1 - damping) + low * damping
        line[:, n % delay] = x[:, n] + low * feedback
        out[:, n] = low
    return out


def all_pass(x: np.ndarray, delay: int, gain: float = 0.5) -> np.ndarray:
    """y = (1 + gain) line - gain x; x + gain y enters the line. A block of `delay` samples at a time."""
    out, line = np.empty_like(x), np.zeros((len(x), delay))
    for at in range(0, x.shape[1], delay):
        block = x[:, at : at + delay]
        size = block.shape[1]
        out[:, at : at + size] = (1 + gain) * line[:, :size] - gain * block
        line[:, :size] = block + gain * out[:, at : at + size]
    return out


def reverb(packed: DataFrame, room: float = 0.8, damping: float = 0.5, wet: float = 0.3, dry: float = 0.7, combs=COMBS, all_passes=ALL_PASSES) -> DataFrame:
    """The sum of damped combs through all-passes, beside the dry signal; parameters are clamped to 0..1."""
    room, damping, wet, dry = (min(max(v, 0.0), 1.0) for v in (room, damping, wet, dry))

    def f(x, _):
        y = sum(comb(x, d, 0.84 * room, damping) for d in combs)
        for d in all_passes:
            y = all_pass(y, d)
        return dry * x + wet * y

    return together(packed, f)


def _phase(lengths: np.ndarray, width: int, rate: float, sample_rate: float) -> np.ndarray:
    """2 pi rate t, t over 0..duration with both ends, for each signal."""
    t = np.arange(width) * (lengths / sample_rate / np.maximum(lengths - 1, 1))[:, None]
    return 2 * np.pi * rate * t


def _line(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """What a delay line of `size` cells holds in cell at[n] before x[n] enters: x[n - 1 - at[n]]; the last cells are read as zero beyond the line."""
    n = np.arange(x.shape[1]) - 1 - at
    ok = (n >= 0) & (at < size)
    return np.where(ok, np.take_along_axis(x, np.maximum(n, 0), 1), 0.0)


def chorus(packed: DataFrame, voices: int = 3, base_delay: float = 0.03, rate_spread: float = 0.2, depth_spread: float = 0.003, wet: float = 0.5, sample_rate: int = 44100) -> DataFrame:
    """Voices with slowly swinging fractional delays, averaged. Nothing feeds back, so every sample is gathered at once."""

    def f(x, lengths):
        total = np.zeros_like(x)
        for v in range(voices):
            rate = 0.5 + rate_spread * (v - voices // 2) / voices
            most = int((base_delay + 0.005 * v + 0.002 + depth_spread * v / voices) * sample_rate)
            delay = most * 0.5 * (1 + np.sin(_phase(lengths, x.shape[1], rate, sample_rate) + v * np.pi / voices))
            k = np.floor(delay).astype(int)
            part = delay - k
            total += (1 - part) * _line(x, k, most + 1) + part * _line(x, k + 1, most + 1)
        return (1 - wet) * x + wet * total / voices

    return together(packed, f)


def flanger(packed: DataFrame, rate: float = 0.5, depth: float = 0.002, feedback: float = 0.7, wet: float = 0.7, sample_rate: int = 44100) -> DataFrame:
    """A swinging delay of up to depth seconds, read between samples, whose output feeds back."""
    most = int(depth * sample_rate)

    def f(x, lengths):
        delay = most * 0.5 * (1 + np.sin(_phase(lengths, x.shape[1], rate, sample_rate)))
        k = np.floor(delay).astype(int)
        part, rows = delay - k, np.arange(len(x))
        line, out = np.zeros((len(x), x.shape[1])), np.empty_like(x)
        for n in range(x.shape[1]):
            one, two = n - 1 - k[:, n], n - 2 - k[:, n]
            a = np.where(one >= 0, line[rows, np.maximum(one, 0)], 0.0)
            b = np.where((two >= 0) & (k[:, n] < most), line[rows, np.maximum(two, 0)], 0.0)
            out[:, n] = a * (1 - part[:, n]) + b * part[:, n]
            line[:, n] = x[:, n] + feedback * out[:, n]
        return (1 - wet) * x + wet * out

    return together(packed, f)


def phaser(packed: DataFrame, rate: float = 0.5, stages: int = 6, depth: float = 0.8, feedback: float = 0.7, wet: float = 0.7, sample_rate: int = 44100, low: float = 200.0, high: float = 1600.0) -> DataFrame:
    """A cascade of first-order stages whose frequency swings; the last output goes on from a stage to the next."""

    def f(x, lengths):
        swing = depth * np.sin(_phase(lengths, x.shape[1], rate, sample_rate))
        y, last = x, np.zeros(len(x))
        ends = [np.flatnonzero(lengths == n + 1) for n in range(x.shape[1])]
        for stage in range(stages):
            alpha = np.tan(np.pi * low * (high / low) ** ((stage + 1) / stages) * (1 + swing) / sample_rate)
            c, out, carried = (alpha - 1) / (alpha + 1), np.empty_like(x), np.zeros(len(x))
            for n in range(x.shape[1]):
                last = c[:, n] * (y[:, n] + feedback * last) + last
                out[:, n] = last
                carried[ends[n]] = last[ends[n]]
            y, last = out, carried  # of each signal's own last sample
        return (1 - wet) * x + wet * y

    return together(packed, f)


def pitch_shift(packed: DataFrame, semitones: float = 12.0, window: int = 2048, wet: float = 1.0) -> DataFrame:
    """Moves each spectral bin k to floor(k 2^(s/12)), at most the last; magnitudes and phases that meet are summed."""
    from corvane.operators.spectra import istft_array, stft_array

    def one(x):
        spec = stft_array(x, window, window // 4)
        to = np.minimum((np.arange(spec.shape[1]) * 2 ** (semitones / 12)).astype(int), spec.shape[1] - 1)
        size, phase = np.zeros(spec.shape), np.zeros(spec.shape)
        np.add.at(size, (slice(None), to), np.abs(spec))
        np.add.at(phase, (slice(None), to), np.angle(spec))
        return (1 - wet) * x + wet * istft_array(size * np.exp(1j * phase), window, window // 4, len(x))

    def f(x, lengths):
        out = np.zeros_like(x)
        for i, n in enumerate(lengths):
            out[i, :n] = one(x[i, :n])
        return out

    return together(packed, f)
