"""Reduction of a prepass frame to its record, by tiles of 8 x 8.

Sums over pixels run in the order of tiles and of pixels in a tile; the regression is narrowed after every tile, so it is a fold over
tiles in order. Padding has no infrared and so never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions.pixel import d
from dustline.operators.analysis import working


def tiles(px: DataFrame) -> DataFrame:
    """(frame_id, ty, tx, n_valid, sr, si, s2 and quadrant deviations of tiles of 64 valid pixels)."""
    w = working(px).withColumns({"ty": F.expr("cast(y div 8 AS int)"), "tx": F.expr("cast(x div 8 AS int)"), "q": F.expr("cast(2 * ((y % 8) div 4) + (x % 8) div 4 AS int)")})
    ok = w.where(F.col("ir") > F.lit(P.IR_THRESHOLD))
    sq = d("ir") * d("ir")
    values = F.array_sort(F.collect_list(F.struct("y", "x", (sq * d("wr")).alias("r"), (sq * d("wi")).alias("i"), sq.alias("s"))))
    by_q = lambda c: [F.sum(F.when(F.col("q") == k, d(c))) for k in range(4)]
    out = ok.groupBy("frame_id", "ty", "tx").agg(
        F.count("*").alias("n_valid"), F.sum("ir").alias("raw"), values.alias("terms"), F.array(*by_q("wr")).alias("qr"), F.array(*by_q("wi")).alias("qi")
    )
    mean = lambda q: F.transform(q, lambda v: (v * 0.0625).cast("float"))
    out = out.withColumns({"qr": mean(F.col("qr")), "qi": mean(F.col("qi"))})
    whole = lambda q: (F.aggregate(q, F.lit(0.0), lambda s, v: s + v.cast("double")) * 0.25).cast("float")
    out = out.withColumns({"ar": whole(F.col("qr")), "ai": whole(F.col("qi"))})
    return out.withColumns({"dr": F.transform("qr", lambda v: v - F.col("ar")), "di": F.transform("qi", lambda v: v - F.col("ai"))})


def records(px: DataFrame) -> DataFrame:
    """One row for each frame: valid pixels and tiles, sums, means, regression, alpha and its scaled form."""
    t = tiles(px).withColumn("raw", d("raw").cast("float"))
    items = F.array_sort(F.collect_list(F.struct("ty", "tx", "n_valid", "raw", "terms", "dr", "di")))
    zero, none = F.lit(0.0), F.lit(0.0).cast("float")
    low, high = P.PREPASS_RATIO

    def tile(s: Column, e: Column) -> Column:
        def pixel(a: Column, v: Column) -> Column:
            return F.struct((a["r"] + v["r"]).alias("r"), (a["i"] + v["i"]).alias("i"), (a["s"] + v["s"]).alias("s"))

        sums = F.aggregate(e["terms"], s["sums"], pixel)
        raw = e["raw"].cast("double")

        def quadrant(a: Column, v: Column) -> Column:
            r, i = v["dr"].cast("double"), v["di"].cast("double")
            ratio = i / r
            use = (r != 0.0) & (ratio >= low) & (ratio <= high)
            w = r * r * raw * raw
            return F.struct(F.when(use, a["den"] + w).otherwise(a["den"]).alias("den"), F.when(use, a["num"] + ratio * w).otherwise(a["num"]).alias("num"))

        pairs = F.arrays_zip(e["dr"].alias("dr"), e["di"].alias("di"))
        grown = F.aggregate(pairs, F.struct(s["den"].cast("double").alias("den"), s["num"].cast("double").alias("num")), quadrant)
        full = e["n_valid"] == 64
        return F.struct(
            sums.alias("sums"), F.when(full, grown["den"].cast("float")).otherwise(s["den"]).alias("den"), F.when(full, grown["num"].cast("float")).otherwise(s["num"]).alias("num"),
            (s["pixels"] + e["n_valid"]).alias("pixels"), (s["tiles"] + full.cast("long")).alias("tiles"),
        )

    first = F.struct(F.struct(zero.alias("r"), zero.alias("i"), zero.alias("s")).alias("sums"), none.alias("den"), none.alias("num"), F.lit(0).cast("long").alias("pixels"), F.lit(0).cast("long").alias("tiles"))
    r = t.groupBy("frame_id").agg(F.aggregate(items, first, tile).alias("v"))
    ratio = F.when(F.col("v.den") == 0, F.lit(P.PREPASS_ZERO_ALPHA)).otherwise(d("v.num") / d("v.den"))
    s = F.col("v.sums.s")
    return r.select(
        "frame_id", F.col("v.pixels").alias("valid_pixels"), F.col("v.tiles").alias("full_tiles"), ratio.cast("float").alias("alpha"), (ratio * P.PREPASS_ALPHA_SCALE).cast("float").alias("alpha_scaled"),
        F.col("v.sums.r").alias("sum_visible"), F.col("v.sums.i").alias("sum_infrared"), s.alias("sum_weight"),
        F.when(s != 0, (F.col("v.sums.r") / s).cast("float")).otherwise(none).alias("mean_visible"), F.when(s != 0, (F.col("v.sums.i") / s).cast("float")).otherwise(none).alias("mean_infrared"),
        F.col("v.den").alias("regression_den"), F.col("v.num").alias("regression_num"), F.lit(P.PREPASS_MARKER).alias("marker"),
    )


def base_primary(rec: DataFrame) -> DataFrame:
    """Adds base: (infrared - alpha visible) / (1 - alpha); an alpha of one raises."""
    a = d("alpha")
    v = ((d("mean_infrared") - a * d("mean_visible")) / (F.lit(1.0) - a)).cast("float")
    return rec.withColumn("base", F.when(a == 1.0, F.raise_error(F.lit("a prepass alpha of one has no base"))).otherwise(v))


def record_bytes(rec: DataFrame) -> DataFrame:
    """frame_id and the 64-byte little-endian form of its record."""
    import struct

    @F.pandas_udf("binary")
    def pack(alpha, scaled, r, i, s, mr, mi, den, num, marker):
        import pandas as pd

        rows = []
        for a, b, x, y, z, u, v, p, q, m in zip(alpha, scaled, r, i, s, mr, mi, den, num, marker):
            rows.append(struct.pack("<Iff4xddd", 1, a, b, x, y, z) + struct.pack("<ffffI4x", u, v, p, q, m))
        return pd.Series(rows)

    return rec.select("frame_id", pack("alpha", "alpha_scaled", "sum_visible", "sum_infrared", "sum_weight", "mean_visible", "mean_infrared", "regression_den", "regression_num", "marker").alias("record"))


def paired(prepass: DataFrame, main: DataFrame) -> DataFrame:
    """Joins acquisitions on same_frame_id; frames of the wrong epoch don't pair."""
    p = prepass.where("epoch = 'prepass'").select("same_frame_id", F.col("frame_id").alias("prepass_id"))
    m = main.where("epoch = 'main'").select("same_frame_id", F.col("frame_id").alias("main_id"))
    return p.join(m, "same_frame_id")


