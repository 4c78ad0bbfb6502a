"""Multiscale neighbourhoods and the reconstruction candidate, as window expressions.

A plane is carried over the frame's edges differently from the decision's bars: columns outside are zero, rows above the
row before the first are zero, that row is the first one weighted by the score's floor, and rows below repeat the last. Vertical sums
are stored in single precision, in a fixed order of addition; horizontal ones are added in double precision from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions.pixel import asymmetric_dead_zone, d
from dustline.operators.analysis import by_column, by_row

PLANES = ("score", "sa", "sr", "sg", "sb")
REACH = 4


def padded(planes: DataFrame) -> DataFrame:
    """Adds rows -1 and H .. H + 4 (pad is true there), so windows over columns need no rule of their own at the frame's edges."""
    names = ["frame_id", "y", "x", "aux", *PLANES]
    keep = planes.select(*names, F.lit(False).alias("pad"))
    floor = F.lit(P.SCORE_FLOOR).cast("float")
    top = planes.where("y = 0").select(
        "frame_id", F.lit(-1).alias("y"), "x", "aux", floor.alias("score"), (F.col("aux") * floor).alias("sa"), *[(F.col(f"w{c}") * floor).alias(f"s{c}") for c in "rgb"], F.lit(True).alias("pad")
    )
    heights = planes.groupBy(F.col("frame_id").alias("__f")).agg(F.max("y").alias("__last"))
    last = planes.join(heights, (F.col("frame_id") == F.col("__f")) & (F.col("y") == F.col("__last")))
    below = last.withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(REACH + 1)))).withColumn("y", F.col("y") + F.col("__d")).select(*names, F.lit(True).alias("pad"))
    return keep.union(top).union(below)


def _at(name: str, k: int, by) -> Column:
    """The value k places on along a window, zero outside."""
    if k == 0:
        return F.col(name)
    return F.lead(name, k, 0.0).over(by) if k > 0 else F.lag(name, -k, 0.0).over(by)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda s, c: s + c.cast("double"), parts[1:], parts[0].cast("double"))


def vertical(pad: DataFrame, planes: tuple[str, ...] = PLANES) -> DataFrame:
    """Of each plane: sums over 3, 5, 7 and 9 rows (the accumulator goes on unrounded) and the vertical half of a binomial filter; of colour planes also the rows above and below."""
    out = {}
    for p in planes:
        order = (-1, 0, 1, -2, 2, -3, 3, -4, 4)
        for n in (3, 5, 7, 9):
            out[f"{p}_{n}"] = _sum([_at(p, k, by_column()) for k in order[:n]]).cast("float")
        out[f"{p}_b"] = (_sum([_at(p, -1, by_column()), F.col(p), _at(p, 1, by_column()), F.col(p)]) * P.Q16).cast("float")
        if p in ("sr", "sg", "sb"):
            out[f"{p}_u"], out[f"{p}_d"] = _at(p, -1, by_column()), _at(p, 1, by_column())
    return pad.withColumns(out)


def averages(scratch: DataFrame, planes: tuple[str, ...] = PLANES) -> DataFrame:
    """Averages in double precision: q69, q21 over rounded 9 x 9 and 5 x 5 masks, q16 binomial; for colour planes the binomial goes across first and isn't narrowed in between."""
    out = {}
    for p in planes:
        at = lambda n, k: _at(f"{p}_{n}", k, by_row())  # noqa: B023, E731
        out[f"{p}_q69"] = _sum([at(5, 4), at(5, -4), at(7, -3), at(7, 3), *[at(9, k) for k in range(-2, 3)]]) * P.Q69
        out[f"{p}_q21"] = _sum([at(3, 2), at(3, -2), at(5, -1), at(5, 0), at(5, 1)]) * P.Q21
        if p in ("sr", "sg", "sb"):
            rows = [_sum([_at(c, -1, by_row()), _at(c, 1, by_row()), F.col(c), F.col(c)]) for c in (f"{p}_u", p, f"{p}_d")]
            out[f"{p}_q16"] = (rows[0] + rows[1] + rows[1] + rows[2]) * P.Q16
        else:
            out[f"{p}_q16"] = _sum([at("b", 0), at("b", -1), at("b", 1), at("b", 0)])
    return scratch.withColumns(out)


def features(avg: DataFrame, fallback: Column) -> DataFrame:
    """Weights W (stored) and feature lanes A (by the unrounded weights), of padded rows too."""
    out = {}
    for n in ("69", "21", "16"):
        out[f"W{n}"] = F.col(f"score_q{n}").cast("float")
        out[f"A{n}"] = F.when(F.col(f"score_q{n}") > 0, (F.col(f"sa_q{n}") / F.col(f"score_q{n}")).cast("float")).otherwise(fallback)
    out["W1"] = F.col("score")
    out["A1"] = F.when(F.col("score") > 0, F.col("aux")).otherwise(fallback)
    return avg.withColumns(out)


LANES = ("A69", "A21", "A16", "A1")


def band_ranges(feat: DataFrame, cross: bool = True) -> DataFrame:
    """Least and greatest change between lanes, at the pixel or also at its four neighbours; beyond the sides a neighbour's lanes are zero."""
    places = [lambda c: F.col(c)]
    if cross:
        places += [lambda c, k=k, by=by: _at(c, k, by) for by in (by_row(), by_column()) for k in (-1, 1)]
    lanes = {f"{c}_{i}": get(c) for c in LANES for i, get in enumerate(places)}
    out = feat.withColumns(lanes)
    ranges = {}
    for band, (a, b) in enumerate(zip(LANES[:-1], LANES[1:])):
        steps = [d(f"{b}_{i}") - d(f"{a}_{i}") for i in range(len(places))]
        ranges[f"lo{band}"] = (F.least(*steps) if len(steps) > 1 else steps[0]).cast("float")
        ranges[f"hi{band}"] = (F.greatest(*steps) if len(steps) > 1 else steps[0]).cast("float")
    return out.withColumns(ranges).drop(*lanes)


def candidates(feat: DataFrame) -> DataFrame:
    """Colour averages by the stored weights; where a weight isn't positive the sum stays as it is."""
    out = {}
    for c in "rgb":
        for n in ("69", "21", "16"):
            w = d(f"W{n}")
            out[f"C{n}{c}"] = F.when(w > 0, F.col(f"s{c}_q{n}") * (F.lit(1.0) / w)).otherwise(F.col(f"s{c}_q{n}")).cast("float")
    return feat.withColumns(out)


def strengths(df: DataFrame, configured: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Band strengths: configured ones, or where they are zero those that the weights give."""
    one = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d("W21") * 2.0).cast("float").cast("double"))).cast("float").cast("double")
    auto = (one, F.greatest(d("W16"), F.lit(0.0)), d("W1") * d("W1"))
    return df.withColumns({f"g{i}": a if c == 0.0 else F.lit(c).cast("double") for i, (a, c) in enumerate(zip(auto, configured))})


def combined(cand: DataFrame) -> DataFrame:
    """The candidate for r, g, b in double precision (k columns), and whether it is valid: all finite and positive. Needs wr, wg, wb and base_write of the pixel."""
    out = {}
    for i, c in enumerate("rgb"):
        v = d(f"C69{c}") + F.lit(P.COARSE_SLOPES[i]) * (d("base_write") - d("A69"))
        for band, (coarse, fine) in enumerate(((f"C69{c}", f"C21{c}"), (f"C21{c}", f"C16{c}"), (f"C16{c}", f"w{c}"))):
            step = F.lit(P.BAND_SCALES[band]) * (d(fine) - d(coarse))
            v = v + F.col(f"g{band}") * asymmetric_dead_zone(step, d(f"lo{band}"), d(f"hi{band}"), P.FACTORS_A[band][i], P.FACTORS_B[band][i])
        out[f"k{c}"] = v
    done = cand.withColumns(out)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) > 0)
    return done.withColumn("valid", finite("kr") & finite("kg") & finite("kb"))


def reconstruction(scored: DataFrame, decided: DataFrame, cross: bool = True) -> DataFrame:
    """Candidates of all eligible pixels of a frame: frame_id, y, x, wr, wg, wb, kr, kg, kb, valid.

    Stencils need all pixels, so eligible ones are picked after them; only their columns go to the join.
    """
    pad = padded(scored)
    feat = features(averages(vertical(pad)), F.lit(0.0).cast("float"))
    cols = ["frame_id", "y", "x", "pad", *LANES, "W69", "W21", "W16", "W1", *[f"s{c}_q{n}" for c in "rgb" for n in ("69", "21", "16")]]
    ranged = candidates(band_ranges(feat.select(*cols), cross)).where("NOT pad")
    picked = decided.where("eligible").select("frame_id", "y", "x", "wr", "wg", "wb", "base_write")
    return combined(strengths(ranged.join(picked, ["frame_id", "y", "x"]))).select("frame_id", "y", "x", "wr", "wg", "wb", "kr", "kg", "kb", "valid")


def kernel_candidate(planes: DataFrame, kernel: list[tuple[int, int, float]], value: str = "aux", policy: str = "sum") -> DataFrame:
    """A score-normalised average by any kernel (dy, dx, weight), added in single precision in the kernel's order; outside is zero.

    policy for sums of weights that aren't positive: `sum` leaves the unnormalised sum, `zero` gives zero.
    """
    f = lambda c: c.cast("float")
    rows = sorted({dy for dy, _, _ in kernel})
    out = planes.withColumns({f"__s{i}": _at("score", dy, by_column()) for i, dy in enumerate(rows)} | {f"__v{i}": _at(value, dy, by_column()) for i, dy in enumerate(rows)})
    num = den = F.lit(0.0).cast("float")
    for dy, dx, w in kernel:
        i = rows.index(dy)
        s = f(_at(f"__s{i}", dx, by_row())) * F.lit(w).cast("float")
        num, den = f(num + f(s * f(_at(f"__v{i}", dx, by_row())))), f(den + s)
    names = planes.columns
    got = out.select(*names, num.alias("num"), den.alias("den"))
    return got.withColumn("candidate", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("num") if policy == "sum" else F.lit(0.0)).cast("float"))
