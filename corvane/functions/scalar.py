"""Scalar column functions: decibel, mel, activations, error function, divisors, PCM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column) -> Column:
    """20 log10 x; null where x is not positive."""
    return F.when(x > 0, 20 * F.log10(x))


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)


#: Coefficients of the rational approximation 7.1.26 in Abramowitz and Stegun (fixed values).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def next_power_of_two(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(x))).cast("long")


def gcd(a: Column, b: Column, steps: int = 90) -> Column:
    """Greatest common divisor of non-negative integers by Euclid's steps (90 suffice for 64 bits)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((a / g).cast("long") * b)


def activation(name: str, x: Column) -> Column:
    """A named activation; an unknown name raises."""
    known = {
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "leaky_relu": lambda: F.when(x > 0, x).otherwise(0.01 * x),
        "elu": lambda: F.when(x > 0, x).otherwise(F.exp(x) - 1),
        "gelu": lambda: 0.5 * x * (1 + erf(x / F.sqrt(F.lit(2.0)))),
        "tanh": lambda: F.tanh(x),
        "sigmoid": lambda: 1 / (1 + F.exp(-x)),
    }
    if name not in known:
        raise ValueError(f"unknown activation: {name}")
    return known[name]()


def snake(x: Column, alpha: Column) -> Column:
    """x + sin(alpha x)^2 / alpha, x where alpha is 0."""
    return F.when(alpha == 0, x).otherwise(x + F.pow(F.sin(alpha * x), 2) / alpha)


def pcm_to_float(x: Column, bits: int = 16) -> Column:
    return x.cast("double") / float(1 << (bits - 1))


def float_to_pcm16(x: Column) -> Column:
    """Truncates x * 32767 toward zero, clamped to the range of 16 bits."""
    return F.least(F.greatest((x * 32767).cast("long"), F.lit(-32768)), F.lit(32767)).cast("int")


def int32_be(binary: Column, at: int = 1) -> Column:
    """Unsigned big-endian 32-bit integer at a 1-based byte offset."""
    return F.conv(F.hex(F.substring(binary, at, 4)), 16, 10).cast("long")


def int32_be_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + eps
    return F.transform(v, lambda x: x / norm)
