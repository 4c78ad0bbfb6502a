"""The writer: conditional dither with one random sequence for each frame, in row-major order.

How many draws a channel takes depends on its first one, so states can't be handed out beforehand. But a draw moves a
value by at most half its envelope times its span: where the candidate lies further from the original than that, the number of draws is known. Sites are
classified at once; only undecided ones are walked one after the other, and the generator jumps over all others. The result is
that of the plain walk, which tests compare it with. The unit of work is a frame, bounded by the sensor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions.pixel import dither_bounds, emit


def jump(state: int | np.ndarray, n: np.ndarray) -> np.ndarray:
    """The generator's states n steps on."""
    n = np.asarray(n, np.int64)
    m, c = np.ones_like(n), np.zeros_like(n)
    pm, pc = P.LCG_FACTOR, P.LCG_STEP
    for bit in range(24):
        on = (n >> bit) & 1 == 1
        c = np.where(on, (c * pm + pc) & P.LCG_MASK, c)
        m = np.where(on, (m * pm) & P.LCG_MASK, m)
        pm, pc = (pm * pm) & P.LCG_MASK, (pc * pm + pc) & P.LCG_MASK
    return (m * state + c) & P.LCG_MASK


def dither(value: np.ndarray, scale: np.ndarray, state: np.ndarray, low: float, high: float) -> np.ndarray:
    """What the draw of `state` adds to values inside the bounds; zero outside, or if the sum leaves them."""
    v = value.astype(np.float32).astype(np.float64)
    inside = (low < v) & (v < high)
    envelope = ((high - v) * (v - low)) * (4.0 / ((high - low) * (high - low)))
    span = (scale * v).astype(np.float32).astype(np.float64)
    delta = envelope * (((state + 1) * P.LCG_UNIT - 0.5) * span)
    moved = v + delta
    return np.where(inside & (low < moved) & (moved < high), delta, 0.0)


def walk(k: np.ndarray, w: np.ndarray, state: int, bounds: tuple[float, float], floor: bool = True) -> tuple[np.ndarray, int, int]:
    """Values [site, channel] for candidates k and originals w of valid sites in order; the last state and the draws."""
    low, high = bounds
    scale = np.broadcast_to(np.array(P.DITHER_SCALES), k.shape).ravel()
    z, o = k.ravel(), w.astype(np.float64).ravel()
    v = z.astype(np.float32).astype(np.float64)
    inside = (low < v) & (v < high)
    limit = np.where(inside, ((high - v) * (v - low)) * (4.0 / ((high - low) * (high - low))) * np.abs(scale * v) * 0.5, 0.0)
    limit = limit * (1 + 1e-6) + 1e-6
    if floor:
        draws = np.where(~inside, 0, np.where(z - limit > o, 2, np.where(z + limit <= o, 1, -1)))
    else:
        draws = inside.astype(np.int64)
    unsure = np.flatnonzero(draws < 0)
    known = np.concatenate(([0], np.cumsum(np.where(draws < 0, 0, draws))))
    gaps = np.diff(known[unsure], prepend=0)
    taken = np.zeros(len(unsure), np.int64)
    if len(unsure):
        now = state
        zs, os_, ss, lows = z[unsure].tolist(), o[unsure].tolist(), scale[unsure], v[unsure]
        env = (((high - lows) * (lows - low)) * (4.0 / ((high - low) * (high - low)))).tolist()
        span = (ss * lows).astype(np.float32).astype(np.float64).tolist()
        lows = lows.tolist()
        steps = jump(0, gaps), jump(1, gaps)  # the affine step of each gap, as its images of 0 and 1
        add, mul = steps[0].tolist(), ((steps[1] - steps[0]) & P.LCG_MASK).tolist()
        for i in range(len(unsure)):
            now = (mul[i] * now + add[i]) & P.LCG_MASK
            now = (P.LCG_FACTOR * now + P.LCG_STEP) & P.LCG_MASK
            delta = env[i] * (((now + 1) * P.LCG_UNIT - 0.5) * span[i])
            if not low < lows[i] + delta < high:
                delta = 0.0
            if zs[i] + delta <= os_[i]:
                taken[i] = 1
            else:
                taken[i] = 2
                now = (P.LCG_FACTOR * now + P.LCG_STEP) & P.LCG_MASK
        draws[unsure] = taken
    before = np.concatenate(([0], np.cumsum(draws)))
    first = jump(state, before[:-1] + 1)
    second = jump(state, before[:-1] + 2)
    d1 = np.where(draws > 0, dither(z, scale, first, low, high), 0.0)
    if floor:
        copied = z + d1 <= o
        out = np.where(copied, o, z + np.where(draws > 0, dither(z, scale, second, low, high), 0.0))
    else:
        out = z + d1
    total = int(before[-1])
    return out.astype(np.float32).reshape(k.shape), int(jump(state, np.array([total]))[0]), total


def written(sites: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """frame_id, y, x, vr, vg, vb for all reconstructed sites, with the frame's draws and last state; invalid candidates keep the original and draw nothing.

    starts: frame_id and state, where a frame's sequence doesn't begin at its initial state.
    """
    bounds = dither_bounds()
    if starts is None:
        sites = sites.withColumn("start", F.lit(P.LCG_SEED))
    else:
        sites = sites.join(starts.select("frame_id", F.col("state").alias("start")), "frame_id")

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        w = pdf[["wr", "wg", "wb"]].to_numpy(np.float32)
        ok = pdf["valid"].to_numpy(bool)
        out = w.copy()
        end, total = int(pdf["start"].iloc[0]), 0
        if ok.any():
            out[ok], end, total = walk(pdf[["kr", "kg", "kb"]].to_numpy(np.float64)[ok], w[ok], end, bounds)
        return pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy(), "y": pdf["y"].to_numpy(), "x": pdf["x"].to_numpy(), "vr": out[:, 0], "vg": out[:, 1], "vb": out[:, 2], "draws": total, "state": end})

    return sites.groupBy("frame_id").applyInPandas(frame, "frame_id string, y int, x int, vr float, vg float, vb float, draws bigint, state int")


def rendered(scored: DataFrame, values: DataFrame) -> DataFrame:
    """Output samples of all pixels, and whether they differ from those of an untouched pixel."""
    both = scored.select("frame_id", "y", "x", "wr", "wg", "wb").join(values.select("frame_id", "y", "x", "vr", "vg", "vb"), ["frame_id", "y", "x"], "left")
    out = both.select("frame_id", "y", "x", *[emit(F.coalesce(f"v{c}", f"w{c}")).alias(c) for c in "rgb"], *[emit(F.col(f"w{c}")).alias(f"n{c}") for c in "rgb"], (F.col("vr").isNotNull()).alias("attempted"), *[(F.col(f"v{c}") != F.col(f"w{c}")).alias(f"d{c}") for c in "rgb"])
    changed = (F.col("r") != F.col("nr")) | (F.col("g") != F.col("ng")) | (F.col("b") != F.col("nb"))
    wrote = F.coalesce(F.col("dr") | F.col("dg") | F.col("db"), F.lit(False))
    return out.select("frame_id", "y", "x", "r", "g", "b", "attempted", wrote.alias("written"), changed.alias("changed"))


def counters(out: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("long")).alias(f"{c}_pixels")
    return out.groupBy("frame_id").agg(F.count("*").alias("pixels"), n("attempted"), n("written"), n("changed"))


def draw_probe(k: float, w: float, channel: int, state: int = P.LCG_SEED) -> tuple[int, int]:
    """How often a channel of one site draws (none outside the bounds, one if the original is taken after the first draw, else two), and the state after it."""
    low, high = dither_bounds()
    z, step = np.array([k]), lambda s: (P.LCG_FACTOR * s + P.LCG_STEP) & P.LCG_MASK
    if not low < np.float32(k) < high:
        return 0, state
    first = step(state)
    moved = z + dither(z, np.array([P.DITHER_SCALES[channel]]), np.array([first]), low, high)
    return (1, first) if moved[0] <= np.float64(np.float32(w)) else (2, step(first))
