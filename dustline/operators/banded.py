"""The neighbourhood operators on arrays: a second engine for bands of rows, and the hidden rows before a frame's first.

reconstruction() gives what stencil.reconstruction() gives, by one exchange of overlapping bands instead of two of pixels; tests hold one against
the other bit for bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions.pixel import dither_bounds
from dustline.operators.writer import walk

F4, F8 = np.float32, np.float64
BAND, HALO = 128, 5


def averages(rows: np.ndarray, colour: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q69, q21, q16 of the middle of nine rows [9, width + 8] at each of width columns."""
    v = rows.astype(F8)
    s3 = v[3] + v[4] + v[5]
    s5 = s3 + v[2] + v[6]
    s7 = s5 + v[1] + v[7]
    s9 = s7 + v[0] + v[8]
    s3, s5, s7, s9 = (s.astype(F4).astype(F8) for s in (s3, s5, s7, s9))
    n = rows.shape[1] - 8
    at = lambda s, k: s[4 + k : 4 + k + n]
    q69 = at(s5, 4) + at(s5, -4) + at(s7, -3) + at(s7, 3)
    for k in range(-2, 3):
        q69 = q69 + at(s9, k)
    q21 = at(s3, 2) + at(s3, -2) + at(s5, -1) + at(s5, 0) + at(s5, 1)
    if colour:
        h = [at(r, -1) + at(r, 1) + at(r, 0) + at(r, 0) for r in (v[3], v[4], v[5])]
        q16 = (h[0] + h[1] + h[1] + h[2]) * P.Q16
    else:
        b = ((v[3] + v[4] + v[5] + v[4]) * P.Q16).astype(F4).astype(F8)
        q16 = at(b, 0) + at(b, -1) + at(b, 1) + at(b, 0)
    return q69 * P.Q69, q21 * P.Q21, q16


def lanes(score9: np.ndarray, sa9: np.ndarray, point_aux: np.ndarray, point_score: np.ndarray, fallback: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights W [4, width] and lanes A [4, width] of a row."""
    q, a = averages(score9), averages(sa9)
    w = np.stack([*(x.astype(F4) for x in q), point_score.astype(F4)])
    out = np.empty_like(w)
    for i in range(3):
        with np.errstate(divide="ignore", invalid="ignore"):
            out[i] = np.where(q[i] > 0, (a[i] / q[i]).astype(F4), F4(fallback))
    out[3] = np.where(w[3] > 0, point_aux, F4(fallback))
    return w, out


def candidate(w: np.ndarray, own: np.ndarray, around: list[np.ndarray], colours: list[tuple], original: np.ndarray, base: float) -> np.ndarray:
    """Candidates [width, 3] of a row from its weights, its lanes, its neighbours' lanes, colour averages and originals [3, width]."""
    stack = np.stack([own, *around]).astype(F8)
    steps = stack[:, 1:] - stack[:, :-1]
    low, high = steps.min(0).astype(F4).astype(F8), steps.max(0).astype(F4).astype(F8)
    w8 = w.astype(F8)
    strength = (np.clip((w8[1] * 2).astype(F4).astype(F8), 0, 1), np.maximum(w8[2], 0), w8[3] * w8[3])
    flip = (low < 0) & (high < 0)
    out = np.empty((w.shape[1], 3))
    for c in range(3):
        with np.errstate(divide="ignore"):
            cs = [np.where(w8[i] > 0, (q * (1.0 / np.where(w8[i] > 0, w8[i], 1.0))), q).astype(F4).astype(F8) for i, q in enumerate(colours[c])]
        cs.append(original[c].astype(F8))
        v = cs[0] + P.COARSE_SLOPES[c] * (F8(base) - own[0].astype(F8))
        for band in range(3):
            step = P.BAND_SCALES[band] * (cs[band + 1] - cs[band])
            a, b = P.FACTORS_A[band][c], P.FACTORS_B[band][c]
            upper = np.where(flip[band], b * high[band], a * high[band])
            lower = np.where(flip[band], a * low[band], b * low[band])
            v = v + strength[band] * np.where(step > upper, step - upper, np.where(step < lower, step - lower, 0.0))
        out[:, c] = v
    return out


def wide(plane: np.ndarray) -> np.ndarray:
    """Four columns of zeros on both sides."""
    return np.pad(plane, ((0, 0), (4, 4)))


def beside(a: np.ndarray) -> list[np.ndarray]:
    """The lanes of the left and the right neighbour; zero beyond the sides."""
    none = np.zeros((4, 1), F4)
    return [np.hstack((none, a[:, :-1])), np.hstack((a[:, 1:], none))]


def startup(score: np.ndarray, aux: np.ndarray, rgb: np.ndarray, base: np.ndarray, state: int = P.LCG_SEED) -> tuple[list[int], list[int], int]:
    """Runs the six hidden rows before a frame: what they write is thrown away, what they draw counts.

    score and aux [5, width], rgb [3, width] of the first rows, base of the first six rows' records. Tried pixels and draws of each row, and the state after them.
    """
    width = score.shape[1]
    floor = F4(P.SCORE_FLOOR)
    hist = {n: np.zeros((15, width), F4) for n in ("s", "a", "r", "g", "b")}  # logical rows -10 .. 4
    hist["s"][9], hist["a"][9] = floor, aux[0] * floor
    hist["s"][10:], hist["a"][10:] = score[:5], score[:5] * aux[:5]
    for i, c in enumerate("rgb"):
        hist[c][9] = rgb[i][0] * floor
        hist[c][10:] = score[:5] * rgb[i][:5]
    hist = {n: wide(p) for n, p in hist.items()}
    raw = np.zeros((15, width + 8), F4)
    for y in range(-10, 5):
        row = aux[max(y, 0)]
        raw[y + 10] = np.concatenate((np.repeat(row[0], 4), row, np.repeat(row[-1] if y >= 0 else F4(0), 4)))
    lows = raw < F4(P.DECISION_THRESHOLD)
    of = lambda stage: float(base[min(max(stage, 1) - 1, len(base) - 1)])

    def record(y: int) -> tuple[np.ndarray, np.ndarray]:
        if y <= -6:
            return np.zeros((4, width), F4), np.zeros((4, width), F4)
        at = slice(y + 6, y + 15)
        return lanes(hist["s"][at], hist["a"][at], raw[y + 10, 4:-4], hist["s"][y + 10, 4:-4], of(y + 6))

    tried, drawn = [], []
    for y in range(-6, 0):
        stage = y + 7
        w, own = record(y)
        around = [*beside(own), record(y - 1)[1], record(y + 1)[1]]
        at = slice(y + 6, y + 15)
        colours = [averages(hist[c][at], True) for c in "rgb"]
        k = candidate(w, own, around, colours, np.stack([p[0] for p in rgb]), of(stage))
        down = lows[at].sum(0)
        across = [np.convolve(lows[r].astype(int), np.ones(9, int), "valid") for r in (y + 6, y + 14)]
        stop = (down[:width] > P.DECISION_LIMIT) | (down[8:] > P.DECISION_LIMIT) | (across[0] > P.DECISION_LIMIT) | (across[1] > P.DECISION_LIMIT) | (w[3] >= 1)
        if stage <= 2:
            stop[width - 4 :] = True
        ok = ~stop & np.isfinite(k).all(1) & (k > 0).all(1)
        tried.append(int((~stop).sum()))
        n = 0
        if ok.any():
            _, state, n = walk(k[ok], np.stack([p[0] for p in rgb], axis=1)[ok], state, dither_bounds())
        drawn.append(n)
    return tried, drawn, state


def startups(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """frame_id, tried and drawn (arrays of six), state: startup() of every frame. Reads five rows of each."""
    first = scored.where("y < 5").select("frame_id", "y", "x", "score", "aux", "wr", "wg", "wb")
    base = rows.where("y < 6").groupBy(F.col("frame_id").alias("__f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "base"))), lambda s: s["base"]).alias("base"))
    both = first.join(base, F.col("frame_id") == F.col("__f")).drop("__f")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        h = int(pdf["y"].max()) + 1
        if h < 5:
            raise ValueError("frames need at least five rows")
        get = lambda c: pdf[c].to_numpy(F4).reshape(h, -1)
        tried, drawn, state = startup(get("score"), get("aux"), [get(c) for c in ("wr", "wg", "wb")], np.asarray(pdf["base"].iloc[0], F4))
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "tried": [tried], "drawn": [drawn], "state": [state]})

    return both.groupBy("frame_id").applyInPandas(run, "frame_id string, tried array<int>, drawn array<int>, state int")


def reconstruction(scored: DataFrame, decided: DataFrame, band: int = BAND) -> DataFrame:
    """stencil.reconstruction() by bands of rows, each with five rows of its neighbours."""
    heights = scored.groupBy(F.col("frame_id").alias("__f")).agg((F.max("y") + 1).alias("h"))
    px = scored.select("frame_id", "y", "x", "aux", "score", "wr", "wg", "wb", "base_write").join(heights, F.col("frame_id") == F.col("__f")).drop("__f")
    px = px.join(decided.select("frame_id", "y", "x", "eligible"), ["frame_id", "y", "x"])
    reach = F.sequence(F.expr(f"greatest(0, (y - {HALO}) div {band})").cast("int"), F.expr(f"least(h - 1, y + {HALO}) div {band}").cast("int"))
    px = px.withColumn("band", F.explode(reach))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        y0, y1, h = int(pdf["y"].min()), int(pdf["y"].max()), int(pdf["h"].iloc[0])
        at = int(pdf["band"].iloc[0])
        get = lambda c, t=F4: pdf[c].to_numpy(t).reshape(y1 - y0 + 1, -1)
        aux, score, rgb = get("aux"), get("score"), [get(c) for c in ("wr", "wg", "wb")]
        ok, base = get("eligible", bool), get("base_write", F8)[:, 0]
        floor = F4(P.SCORE_FLOOR)

        def plane(p: np.ndarray, weighted: bool = True) -> np.ndarray:
            v = score * p if weighted else score
            above = [np.zeros((HALO - 1, p.shape[1]), F4), (p[:1] * floor if weighted else np.full((1, p.shape[1]), floor))] if y0 == 0 else []
            below = [np.repeat(v[-1:], HALO, axis=0)] if y1 == h - 1 else []
            return wide(np.concatenate((*above, v, *below)))

        top = HALO if y0 == 0 else 0
        s, a = plane(aux, False), plane(aux)
        colours = [plane(p) for p in rgb]

        def record(y: int) -> tuple[np.ndarray, np.ndarray]:
            i = y - y0 + top
            point = aux[min(max(y, 0), h - 1) - y0]
            return lanes(s[i - 4 : i + 5], a[i - 4 : i + 5], point, s[i, 4:-4], 0.0)

        out, held = [], {}
        for y in range(at * band, min((at + 1) * band, h)):
            use = ok[y - y0]
            if not use.any():
                continue
            for n in (y - 1, y, y + 1):
                if n not in held:
                    held[n] = record(n)
            held.pop(y - 2, None)
            w, own = held[y]
            i = y - y0 + top
            k = candidate(w, own, [*beside(own), held[y - 1][1], held[y + 1][1]], [averages(c[i - 4 : i + 5], True) for c in colours], np.stack([p[y - y0] for p in rgb]), base[y - y0])[use]
            x = np.flatnonzero(use)
            out.append(pd.DataFrame({"y": y, "x": x, **{f"w{c}": p[y - y0][use] for c, p in zip("rgb", rgb)}, **{f"k{c}": k[:, j] for j, c in enumerate("rgb")}, "valid": np.isfinite(k).all(1) & (k > 0).all(1)}))
        names = ["frame_id", "y", "x", "wr", "wg", "wb", "kr", "kg", "kb", "valid"]
        if not out:
            return pd.DataFrame(columns=names)
        return pd.concat(out).assign(frame_id=pdf["frame_id"].iloc[0])[names]

    return px.groupBy("frame_id", "band").applyInPandas(run, "frame_id string, y int, x int, wr float, wg float, wb float, kr double, kg double, kb double, valid boolean")
