"""From samples to scores: working values, row calibration, auxiliary, score and weighted planes, decision bars.

Windows are partitioned by frame and one axis, so each holds a row or a column of one frame; there are at most two exchanges of the pixels for a
separable neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions import pixel as X


def by_row():
    """Made when asked for: a window needs a session, which workers that import this module don't have."""
    return Window.partitionBy("frame_id", "y").orderBy("x")


def by_column():
    return Window.partitionBy("frame_id", "x").orderBy("y")


def by_frame():
    return Window.partitionBy("frame_id").orderBy("y")


def working(px: DataFrame) -> DataFrame:
    return px.withColumns({f"w{n}": X.response(F.col(c)) for n, c in (("r", "r"), ("g", "g"), ("b", "b"), ("i", "ir"))})


def per_channel_response(px: DataFrame, tables: DataFrame) -> DataFrame:
    """Explicit tables (v, tr, tg, tb, ti) of at most 65,536 rows; the bound makes them safe to broadcast."""
    out = px
    for c, t in (("r", "tr"), ("g", "tg"), ("b", "tb"), ("ir", "ti")):
        one = tables.select(F.col("v").alias(f"__{c}"), F.col(t).alias(f"w{c[0]}"))
        out = out.join(F.broadcast(one), F.col(c) == F.col(f"__{c}")).drop(f"__{c}")
    return out


def latch(px: DataFrame, threshold: float = P.IR_THRESHOLD) -> DataFrame:
    """accepted: no pixel of the 8 x 8 cell up to this one, row by row, is at or below the threshold; only whole cells across count."""
    cell = Window.partitionBy("frame_id", "band", "cell").orderBy("y", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = px.withColumns({"band": F.expr("cast(y div 8 AS int)"), "cell": F.expr("cast(x div 8 AS int)")})
    wide = F.max("x").over(Window.partitionBy("frame_id", "y")) + 1
    out = out.withColumn("active", F.col("x") < F.expr("8") * F.floor(wide / 8))
    low = (F.col("ir") <= F.lit(threshold)).cast("int")
    return out.withColumn("accepted", F.col("active") & (F.max(low).over(cell) == 0))


def fold(value: Column, *order: str) -> Column:
    """Sum of doubles in a stated order: aggregates alone don't keep one."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return F.aggregate(ordered, F.lit(0.0), lambda s, v: s + v["v"])


def row_sums(latched: DataFrame) -> DataFrame:
    """By row, in the order of columns: sums of ir^2 r, ir^2 ir and ir^2, and how many pixels are accepted."""
    w = F.when(F.col("accepted"), F.col("ir").cast("double") * F.col("ir").cast("double")).otherwise(0.0)
    return latched.groupBy("frame_id", "y").agg(
        fold(w * X.d("wr"), "x").alias("visible"),
        fold(w * X.d("wi"), "x").alias("infrared"),
        F.sum(w).alias("weight"),  # integers below 2^53: exact in any order
        F.sum(F.col("accepted").cast("int")).cast("int").alias("n_accepted"),
    )


def cumulative_means(sums: DataFrame) -> DataFrame:
    """Running means by row; rows before any accepted pixel keep the initial ones."""
    run = by_frame().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sums.withColumns({f"t_{c}": F.sum(c).over(run) for c in ("visible", "infrared", "weight")})
    some = F.col("t_weight") != 0.0
    return s.withColumns(
        {
            "mean_visible": F.when(some, (F.col("t_visible") / F.col("t_weight")).cast("float")).otherwise(F.lit(P.INITIAL_VISIBLE_MEAN).cast("float")),
            "mean_infrared": F.when(some, (F.col("t_infrared") / F.col("t_weight")).cast("float")).otherwise(F.lit(P.INITIAL_INFRARED_MEAN).cast("float")),
        }
    )


def quadrants(latched: DataFrame) -> DataFrame:
    """Of each cell of 64 valid pixels, four quadrants' deviations from the cell's mean, in single precision; raw is the sum of infrared samples."""
    whole = Window.partitionBy("frame_id", "band", "cell")
    valid = latched.where("active").withColumn("n", F.count(F.when(F.col("ir") > F.lit(P.IR_THRESHOLD), 1)).over(whole)).where("n = 64")
    valid = valid.withColumn("q", F.expr("cast(2 * ((y % 8) div 4) + (x % 8) div 4 AS int)"))
    means = valid.groupBy("frame_id", "band", "cell", "q").agg(
        (F.sum(X.d("wr")) * 0.0625).cast("float").alias("mv"), (F.sum(X.d("wi")) * 0.0625).cast("float").alias("mi"), F.sum("ir").alias("ir")
    )
    cell = means.withColumns({"av": (F.sum(X.d("mv")).over(whole) * 0.25).cast("float"), "ai": (F.sum(X.d("mi")).over(whole) * 0.25).cast("float"), "raw": F.sum("ir").over(whole)})
    return cell.select("frame_id", "band", "cell", "q", (F.col("mv") - F.col("av")).alias("dv"), (F.col("mi") - F.col("ai")).alias("di"), "raw")


def scale_epochs(quads: DataFrame) -> DataFrame:
    """By band of eight rows: what its cells add to the scale's denominator and numerator, in the order of cells and quadrants."""
    v, i = X.d("dv"), X.d("di")
    ratio = F.when(v == 0.0, 0.0).otherwise(i / v)
    weight = F.when((v == 0.0) | (ratio < P.SCALE_RATIO_LOW) | (ratio > P.SCALE_RATIO_HIGH), 0.0).otherwise(
        F.when((ratio < P.SCALE_RATIO_FULL_LOW) | (ratio > P.SCALE_RATIO_FULL_HIGH), v * P.SCALE_OUTER_WEIGHT).otherwise(v)
    )
    terms = quads.withColumn("ratio", ratio).withColumn("term", weight * weight * X.d("raw") * X.d("raw"))
    return terms.groupBy("frame_id", "band").agg(
        fold(F.col("term"), "cell", "q").cast("float").alias("add_den"), fold(F.col("ratio") * F.col("term"), "cell", "q").cast("float").alias("add_num")
    )


def scale_states(epochs: DataFrame, rows: DataFrame) -> DataFrame:
    """(frame_id, band, p1, p2) after each complete band: sums are stored in single precision, the ratio comes from them unrounded."""
    bands = rows.groupBy("frame_id").agg(F.expr("cast(max(y) + 1 AS int) div 8").alias("n"))
    bands = bands.where("n > 0").select("frame_id", F.explode(F.expr("sequence(0, cast(n AS int) - 1)")).alias("band"))
    full = bands.join(epochs, ["frame_id", "band"], "left").na.fill(0.0, ["add_den", "add_num"])
    items = F.array_sort(F.collect_list(F.struct("band", "add_den", "add_num")))
    zero = F.lit(0.0).cast("float")
    first = F.struct(zero.alias("den"), zero.alias("num"), F.lit(P.INITIAL_SCALE).cast("float").alias("p1"), F.lit(P.INITIAL_SCALE).cast("float").alias("p2"))

    def step(s: Column, e: Column) -> Column:
        last = F.element_at(s, -1)
        den, num = X.d(last["den"]) + X.d(e["add_den"]), X.d(last["num"]) + X.d(e["add_num"])
        some = den != 0.0
        now = F.struct(
            den.cast("float").alias("den"),
            num.cast("float").alias("num"),
            F.when(some, (F.lit(P.SCALE_MULTIPLIER) * (num / den)).cast("float")).otherwise(last["p1"]).alias("p1"),
            F.when(some, (num / den).cast("float")).otherwise(last["p2"]).alias("p2"),
        )
        return F.concat(s, F.array(now))

    states = full.groupBy("frame_id").agg(F.aggregate(items, F.array(first), step).alias("s"))
    return states.select("frame_id", F.posexplode("s").alias("done", "v")).select("frame_id", "done", "v.den", "v.num", "v.p1", "v.p2")


def calibration(latched: DataFrame) -> DataFrame:
    """One row for each row of a frame: its record (p1..p4) and what the setter makes of it, and what later rows' records lend to scoring and writing."""
    means = cumulative_means(row_sums(latched))
    states = scale_states(scale_epochs(quadrants(latched)), means)
    rec = means.withColumn("done", F.expr("cast((y + 1) div 8 AS int)")).join(states, ["frame_id", "done"], "left")
    for c in ("p1", "p2"):
        rec = rec.withColumn(c, F.coalesce(c, F.lit(P.INITIAL_SCALE).cast("float")))
    sign = F.when(F.col("p2") < 0, -1.0).otherwise(1.0).cast("float")
    rec = rec.withColumns({"q1": F.col("p1") * sign, "q2": F.col("p2") * sign})
    den = F.lit(1.0) - X.d("q2")
    base = ((X.d("mean_infrared") - X.d("mean_visible") * X.d("q2")) / den).cast("float")
    gate = ~((F.col("mean_visible") != 0) & (F.col("q2") <= F.lit(P.WRITER_GATE).cast("float")))
    fail = (F.col("q2") == 1) | (F.col("q1") == 1)
    rec = rec.withColumn("base", F.when(fail, F.raise_error(F.lit("a scale of one has no calibration"))).otherwise(base))
    rec = rec.withColumns({"alpha": F.col("q2"), "gate2": gate, "reciprocal1": (F.lit(1.0) / (F.lit(1.0) - X.d("q1"))).cast("float"), "reciprocal2": (F.lit(1.0) / den).cast("float")})
    last = F.last("base").over(by_frame().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the score of a row uses the record one row on, the writer six rows on; the last record holds
    return rec.withColumns({"base_score": F.coalesce(F.lead("base", 1).over(by_frame()), "base"), "base_write": F.coalesce(F.lead("base", 6).over(by_frame()), last)})


def auxiliary_plane(work: DataFrame, rows: DataFrame) -> DataFrame:
    """Pixels with aux and their row's base_score and base_write. The join is left to the planner: rows number one for each row of each frame."""
    both = work.join(rows.select("frame_id", "y", "alpha", "base", "base_score", "base_write"), ["frame_id", "y"])
    return both.withColumn("aux", X.auxiliary(F.col("wi"), F.col("wr"), F.col("alpha"), F.col("base"))).drop("alpha", "base")


def score_plane(aux: DataFrame, minimum: bool = True) -> DataFrame:
    """score of each pixel: of the least of itself and its two neighbours in the row, at the row's ends of itself."""
    sample = F.col("aux")
    if minimum:
        left, right = F.lag("aux").over(by_row()), F.lead("aux").over(by_row())
        sample = F.when(left.isNull() | right.isNull(), F.col("aux")).otherwise(F.least(left, F.col("aux"), right))
    return aux.withColumn("score", X.score(sample, F.col("base_score")))


def weighted_planes(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"sa": F.col("score") * F.col("aux"), **{f"s{c}": F.col("score") * F.col(f"w{c}") for c in "rgb"}})


def analysed(px: DataFrame) -> DataFrame:
    """All of the above for whole frames."""
    work = working(px)
    return weighted_planes(score_plane(auxiliary_plane(work, calibration(latch(work)))))


def decision(aux: DataFrame, policy: str = "replicate", threshold: float = P.DECISION_THRESHOLD, limit: int = P.DECISION_LIMIT, radius: int = P.DECISION_RADIUS) -> DataFrame:
    """fallback: of four bars of nine samples at `radius` from the pixel, one has more than `limit` samples below the threshold.

    Outside the frame: `replicate` repeats its edge, `fallback` counts an incomplete bar as one over the limit, `error` raises.
    """
    if policy not in ("replicate", "fallback", "error"):
        raise ValueError(f"unknown policy {policy!r}")
    low = (F.col("aux") < F.lit(threshold).cast("float")).cast("int")
    out = aux.withColumn("__low", low)
    for axis, by, other, name in (("y", by_column(), by_row(), "v"), ("x", by_row(), by_column(), "h")):
        every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        n = F.max(axis).over(every) + 1
        count = F.sum("__low").over(by.rowsBetween(-4, 4))
        above, below = F.greatest(F.lit(0), 4 - F.col(axis)), F.greatest(F.lit(0), F.col(axis) + 5 - n)
        edged = count + above * F.first("__low").over(every) + below * F.last("__low").over(every)
        out = out.withColumn(f"__{name}", edged if policy == "replicate" else count)
        out = out.withColumn(f"__in_{name}", (above + below) == 0)
    bars, inside = [], []
    for name, by in (("v", by_row()), ("h", by_column())):
        every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for shift, end in ((F.lag, F.first), (F.lead, F.last)):
            at = shift(f"__{name}", radius).over(by)
            there = shift(F.lit(True), radius).over(by)
            if policy == "replicate":
                at = F.coalesce(at, end(f"__{name}").over(every))
            bars.append(F.coalesce(at, F.lit(0)))
            inside.append(F.coalesce(there, F.lit(False)) & F.col(f"__in_{name}"))
    for i, b in enumerate(bars):
        out = out.withColumn(f"bar{i}", b.cast("int"))
    whole = inside[0] & inside[1] & inside[2] & inside[3]
    out = out.withColumn("boundary", ~whole)
    over = F.greatest(*[F.col(f"bar{i}") for i in range(4)]) > limit
    if policy == "fallback":
        over = over | F.col("boundary")
    if policy == "error":
        over = F.when(F.col("boundary"), F.raise_error(F.lit("decision bars cross the frame's edge"))).otherwise(over)
    return out.withColumn("fallback", over).drop("__low", "__v", "__h", "__in_v", "__in_h")


def group_fallback(groups: Column, threshold: float = P.DECISION_THRESHOLD, limit: int = P.DECISION_LIMIT) -> Column:
    """The same for explicit groups: an array of arrays of samples."""
    return F.exists(groups, lambda g: F.size(F.filter(g, lambda v: v < F.lit(threshold).cast("float"))) > limit)


def eligible(decided: DataFrame, row_gate: int = 0) -> DataFrame:
    """Pixels that reconstruction is tried for."""
    return decided.withColumn("eligible", ~F.col("fallback") & (F.col("score") < 1) if row_gate == 0 else F.lit(False))


def render(df: DataFrame, forced: Column, fallback: Column, made: Column, valid: Column) -> Column:
    """The reconstruction where it is asked for and valid, the fallback canvas elsewhere."""
    return F.when(~forced & F.coalesce(valid, F.lit(False)), made).otherwise(fallback)
