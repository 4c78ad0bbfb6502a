"""Point-wise expressions on pixel columns. Each states where it narrows to single precision, as results depend on it."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from dustline import profile as P

_INVERSE = 16.0 * math.log10(2.0) / 65535.0
#: Fixed value: the digest of the single-precision response table, little-endian.
RESPONSE_SHA256_PREFIX = "5fd225e2"


def d(x) -> Column:
    return F.col(x).cast("double") if isinstance(x, str) else x.cast("double")


def response(v: Column) -> Column:
    """Logarithmic response of a 16-bit sample."""
    return (F.lit(65535.0) * F.log2(v.cast("double") + 1.0) / F.lit(16.0)).cast("float")


def response_table() -> np.ndarray:
    """The same for all samples, on the driver; refused if this machine's logarithm differs in a bit."""
    table = (65535.0 * np.log2(np.arange(65536.0) + 1.0) / 16.0).astype("<f4")
    if not hashlib.sha256(table.tobytes()).hexdigest().startswith(RESPONSE_SHA256_PREFIX):
        raise ValueError("this platform's logarithm doesn't give the response table")
    return table


def linear_response(v: Column, gain: float, offset: float) -> Column:
    """Gain and offset, each step in single precision."""
    return v.cast("float") * F.lit(gain).cast("float") + F.lit(offset).cast("float")


def work_index(v: Column) -> Column:
    """Half-up index of a working value, clamped to 16 bits."""
    return F.least(F.greatest(v.cast("double") + 0.5, F.lit(0.0)), F.lit(65535.0)).cast("int")


def high_factor(i: Column) -> Column:
    return F.floor(F.lit(16.0) * F.pow(F.lit(10.0), F.lit(256.0) * i.cast("double") * F.lit(_INVERSE)) + 0.5)


def low_factor(i: Column) -> Column:
    return F.floor(F.lit(65536.0) * F.pow(F.lit(10.0), i.cast("double") * F.lit(_INVERSE)) + 0.5)


def inverse_response(index: Column) -> Column:
    """16-bit sample of a response index: product of a factor for its high and one for its low byte."""
    return (F.shiftright(high_factor(F.shiftright(index, 8)) * low_factor(index.bitwiseAND(255)), 20) - 1).cast("int")


def emit(v: Column) -> Column:
    return inverse_response(work_index(v))


def auxiliary(ir: Column, visible: Column, alpha: Column, replacement: Column) -> Column:
    """Infrared less visible cross-talk, in double precision with one narrowing; a constant plane where alpha is one."""
    a = alpha.cast("double")
    plane = ((ir.cast("double") - a * visible.cast("double")) / (F.lit(1.0) - a) - P.AUXILIARY_OFFSET).cast("float")
    return F.when(a == 1.0, replacement.cast("float")).otherwise(plane)


def score(sample: Column, base: Column) -> Column:
    raw = ((base.cast("double") + P.SCORE_ADDEND) - sample.cast("double")) * P.SCORE_SCALE + P.SCORE_OFFSET
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(P.SCORE_FLOOR)).cast("float")


def at_floor(s: Column) -> Column:
    return s == F.lit(P.SCORE_FLOOR).cast("float")


def dead_zone(v: Column, low: Column, high: Column) -> Column:
    """What exceeds an interval, in single precision."""
    v, low, high = (x.cast("float") for x in (v, low, high))
    return F.when(v < low, v - low).when(v > high, v - high).otherwise(F.lit(0.0).cast("float"))


def asymmetric_dead_zone(v: Column, low: Column, high: Column, a: float, b: float) -> Column:
    """What exceeds a range scaled by a and b, which change sides where the whole range is negative."""
    flip = (low < 0) & (high < 0)
    upper = F.when(flip, high * b).otherwise(high * a)
    lower = F.when(flip, low * a).otherwise(low * b)
    return F.when(v > upper, v - upper).when(v < lower, v - lower).otherwise(0.0)


def combine_bands(a: Column, b: Column, c: Column, source: Column, limits: list[tuple[Column, Column]], weights: tuple[float, float, float]) -> Column:
    """a + w dz(b - a) + w dz(c - b) + w dz(source - c), each step in single precision."""
    bands = [dead_zone(x.cast("float") - y.cast("float"), *lim) for (x, y), lim in zip(((b, a), (c, b), (source, c)), limits)]
    return reduce(lambda s, bw: s + bw[0] * F.lit(bw[1]).cast("float"), zip(bands, weights), a.cast("float"))


def encode8(v: Column, low: Column, high: Column) -> Column:
    """16-bit sample to 8 bits over a range, half up and clipped; an empty range gives 0."""
    scaled = F.floor((v.cast("double") - low) * 255.0 / (high - low).cast("double") + 0.5)
    return F.when(low == high, 0).otherwise(F.least(F.greatest(scaled, F.lit(0)), F.lit(255))).cast("int")


def decode16(v: Column, low: Column, high: Column) -> Column:
    back = F.floor(low.cast("double") + v.cast("double") * (high - low).cast("double") / 255.0 + 0.5)
    return F.least(F.greatest(back, F.lit(0)), F.lit(65535)).cast("int")


def blend(source: Column, made: Column, alpha: Column) -> Column:
    mixed = F.floor(source.cast("double") * (F.lit(1.0) - alpha) + made.cast("double") * alpha + 0.5)
    return F.least(F.greatest(mixed, F.lit(0)), F.lit(65535)).cast("int")


def lcg_jump(state: Column, n: Column) -> Column:
    """The state n steps on, by squaring the affine step; products stay under 2^48. n counts below 2^24 (the period)."""
    start = F.struct(F.lit(1).cast("long").alias("m"), F.lit(0).cast("long").alias("c"), F.lit(P.LCG_FACTOR).cast("long").alias("pm"), F.lit(P.LCG_STEP).cast("long").alias("pc"))

    def step(s: Column, bit: Column) -> Column:
        on = F.pmod(F.floor(n.cast("double") / F.pow(F.lit(2.0), bit.cast("double"))), F.lit(2)) == 1
        mask = F.lit(P.LCG_MASK).cast("long")
        return F.struct(
            F.when(on, (s["m"] * s["pm"]).bitwiseAND(mask)).otherwise(s["m"]).alias("m"),
            F.when(on, (s["c"] * s["pm"] + s["pc"]).bitwiseAND(mask)).otherwise(s["c"]).alias("c"),
            (s["pm"] * s["pm"]).bitwiseAND(mask).alias("pm"),
            (s["pc"] * s["pm"] + s["pc"]).bitwiseAND(mask).alias("pc"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(23)), start, step)
    return ((done["m"] * state.cast("long") + done["c"]).bitwiseAND(F.lit(P.LCG_MASK).cast("long"))).cast("int")


def lcg_unit(state: Column) -> Column:
    """The centred draw of a state: above -1/2 and below 1/2."""
    return (state.cast("double") + 1.0) * P.LCG_UNIT - 0.5


def percentile_indices(n: int) -> tuple[int, int]:
    """Truncated one and 99 per cent of n, the products in single precision."""
    return tuple(min(int(np.float32(n) * np.float32(p)), n) for p in (0.01, 0.99))


def dither_bounds() -> tuple[float, float]:
    table = response_table()
    low, high = percentile_indices(65535)
    return float(table[low]), float(table[high])
