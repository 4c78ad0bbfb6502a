"""Regions of a mask: labels, distances, dilation, routing to synthesis and its census.

A frame's mask is reduced to runs (a few per row) before anything is grouped by frame; labelling joins runs of a frame by union-find in one
task. Ids follow the raster order of regions' first pixels.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.operators.analysis import by_column, by_row
from dustline.sources.frames import cut

RUN = "frame_id string, part string, y int, x0 int, x1 int"


def runs(mask: DataFrame, part: str | None = None) -> DataFrame:
    """Maximal runs of true pixels in a row: (frame_id, part, y, x0, x1), both ends included. part keeps regions apart (tiles)."""
    m = mask.where("mask").withColumn("part", F.col(part).cast("string") if part else F.lit(""))
    w = Window.partitionBy("frame_id", "y", "part").orderBy("x")
    m = m.withColumn("g", F.col("x") - F.row_number().over(w))
    return m.groupBy("frame_id", "part", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over runs of one frame that touch, corners included; label is the raster rank of a region's first pixel."""
    pdf = pdf.sort_values(["part", "y", "x0"], kind="stable").reset_index(drop=True)
    part, y, x0, x1 = (pdf[c].to_numpy() for c in ("part", "y", "x0", "x1"))
    root = list(range(len(pdf)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    j = 0
    for i in range(len(pdf)):
        while j < i and (part[j] != part[i] or y[j] < y[i] - 1 or (y[j] == y[i] - 1 and x1[j] < x0[i] - 1)):
            j += 1
        k = j
        while k < i and part[k] == part[i] and y[k] == y[i] - 1 and x0[k] <= x1[i] + 1:
            a, b = find(i), find(k)
            root[max(a, b)] = min(a, b)
            k += 1
    top = np.array([find(i) for i in range(len(pdf))])
    # the first pixel in raster order is the leftmost one of the top row
    lead = pd.DataFrame({"t": top, "y": y, "x": x0}).sort_values(["y", "x"]).drop_duplicates("t")
    rank = {t: n for n, t in enumerate(lead["t"], start=1)}
    return pdf.assign(label=[rank[t] for t in top])[["frame_id", "part", "y", "x0", "x1", "label"]]


def labelled_runs(mask: DataFrame, part: str | None = None) -> DataFrame:
    return runs(mask, part).groupBy("frame_id").applyInPandas(_join, RUN + ", label int")


def spread(labelled: DataFrame) -> DataFrame:
    """Pixels of runs: (frame_id, y, x, label)."""
    return labelled.select("frame_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def labels(mask: DataFrame) -> DataFrame:
    """Mask pixels with the label of their 8-connected region."""
    return spread(labelled_runs(mask))


def guarded(mask: DataFrame) -> DataFrame:
    """Raises for a frame without any pixel outside the mask, as nothing could be made of it."""
    ok = mask.groupBy(F.col("frame_id").alias("__f")).agg(F.min(F.col("mask").cast("int")).alias("__all"))
    return mask.join(ok, F.col("frame_id") == F.col("__f")).withColumn("mask", F.when(F.col("__all") == 1, F.raise_error(F.lit("a frame's mask leaves no context"))).otherwise(F.col("mask"))).drop("__f", "__all")


def distances(lab: DataFrame, size: DataFrame) -> DataFrame:
    """Chessboard distance of labelled pixels to the nearest pixel outside the mask; what lies outside the frame is no background.

    lab: (frame_id, y, x, label), size: (frame_id, h, w). A task holds one region's box: regions don't touch, so on the way to
    another region a pixel outside both is always nearer, and a region is eroded on its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        h, w, top, side = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), int(y.min()), int(x.min())
        left = np.zeros((int(y.max()) - top + 3, int(x.max()) - side + 3), bool)  # with a ring around the box
        left[y - top + 1, x - side + 1] = True
        beyond = np.zeros_like(left)  # of the ring, what is no pixel of the frame
        beyond[0], beyond[-1] = top == 0, y.max() == h - 1
        beyond[:, 0] |= side == 0
        beyond[:, -1] |= bool(x.max() == w - 1)
        left |= beyond
        dist = np.zeros(left.shape, np.int32)
        inner = ~beyond
        while (left & inner).any() and not left.all():
            dist += left
            v = left.copy()
            v[1:-1] = left[:-2] & left[1:-1] & left[2:]
            out = v.copy()
            out[:, 1:-1] = v[:, :-2] & v[:, 1:-1] & v[:, 2:]
            left = out | beyond
        return pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy(), "label": pdf["label"].to_numpy(), "y": y, "x": x, "distance": dist[y - top + 1, x - side + 1]})

    px = lab.join(size, "frame_id").select("frame_id", "label", "y", "x", "h", "w")
    return px.groupBy("frame_id", "label").applyInPandas(run, "frame_id string, label int, y int, x int, distance int")


def frame_sizes(px: DataFrame) -> DataFrame:
    """(frame_id, h, w)."""
    return px.groupBy("frame_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def dilate(df: DataFrame, column: str, margin: int = P.ROUTING_MARGIN) -> DataFrame:
    """Adds dilated: a set pixel lies within `margin` rows and columns. Down first, then across."""
    v = F.max(F.col(column).cast("int")).over(by_column().rowsBetween(-margin, margin))
    out = df.withColumn("__v", v)
    return out.withColumn("dilated", F.max("__v").over(by_row().rowsBetween(-margin, margin)) == 1).drop("__v")


def region_table(mask: DataFrame, lab: DataFrame, min_area: int = P.ROUTING_MIN_AREA, min_radius: int = P.ROUTING_MIN_RADIUS) -> DataFrame:
    """(frame_id, label, y0, x0, y1, x1, area, radius, reason, perimeter): boxes are half open; perimeter marks the region that holds the whole border of its frame."""
    size = frame_sizes(mask)
    px = distances(lab, size).join(size, "frame_id")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x") == F.col("w") - 1)
    t = px.groupBy("frame_id", "label").agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.count("*").alias("area"), F.max("distance").alias("radius"),
        F.sum(edge.cast("int")).alias("__edge"), F.first("h").alias("h"), F.first("w").alias("w"),
    )
    whole = F.when((F.col("h") == 1) | (F.col("w") == 1), F.col("h") * F.col("w")).otherwise(2 * (F.col("h") + F.col("w")) - 4)
    a, r = F.col("area") >= min_area, F.col("radius") >= min_radius
    reason = F.when(a & r, "area+chessboard_radius").when(a, "area").when(r, "chessboard_radius").otherwise("not_routed")
    return t.withColumns({"reason": reason, "perimeter": F.col("__edge") == whole}).drop("__edge", "h", "w")


def synthesis(mask: DataFrame, lab: DataFrame, table: DataFrame, margin: int = P.ROUTING_MARGIN) -> DataFrame:
    """All pixels with label, at_floor, routed, perimeter and synth: the routed regions, dilated, less the perimeter region."""
    t = table.select("frame_id", "label", (F.col("reason") != "not_routed").alias("hit"), "perimeter")
    px = mask.join(lab, ["frame_id", "y", "x"], "left").join(t, ["frame_id", "label"], "left")
    px = px.withColumns({"routed": F.coalesce(F.col("hit") & ~F.col("perimeter"), F.lit(False)), "perimeter": F.coalesce("perimeter", F.lit(False))})
    grown = dilate(px, "routed", margin) if margin else px.withColumn("dilated", F.col("routed"))
    return grown.select("frame_id", "y", "x", F.col("mask").alias("at_floor"), "label", "routed", "perimeter", "dilated", (F.col("dilated") & ~F.col("perimeter")).alias("synth"))


def final_labels(synth: DataFrame, margin: int = P.CROP_MARGIN, most: int = P.MAX_CROP_PIXELS, edge: int = P.TILE_EDGE) -> DataFrame:
    """(frame_id, y, x, final): regions of the synthesis mask; those whose crop would be too large are cut on a grid from their box and labelled anew in each tile. Ids follow boxes."""
    size = synth.groupBy(F.col("frame_id").alias("__f")).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    raw = labelled_runs(synth.select("frame_id", "y", "x", F.col("synth").alias("mask")))
    box = raw.groupBy("frame_id", F.col("label").alias("raw")).agg(F.min("y").alias("y0"), F.min("x0").alias("b0"), (F.max("y") + 1).alias("y1"), (F.max("x1") + 1).alias("b1"))
    box = box.join(size, F.col("frame_id") == F.col("__f")).drop("__f")
    crop = (F.least("h", F.col("y1") + margin) - F.greatest(F.lit(0), F.col("y0") - margin)).cast("long") * (F.least("w", F.col("b1") + margin) - F.greatest(F.lit(0), F.col("b0") - margin))
    box = box.withColumn("large", crop > most).select("frame_id", "raw", "y0", "b0", "large")
    px = spread(raw).withColumnRenamed("label", "raw").join(box, ["frame_id", "raw"])
    tile = F.when(F.col("large"), F.concat_ws("/", F.col("raw"), F.expr(f"(y - y0) div {edge}"), F.expr(f"(x - b0) div {edge}"))).otherwise(F.col("raw").cast("string"))
    px = px.withColumns({"part": tile, "ty": F.when(F.col("large"), F.expr(f"(y - y0) div {edge}")).otherwise(0), "tx": F.when(F.col("large"), F.expr(f"(x - b0) div {edge}")).otherwise(0), "mask": F.lit(True)})
    again = labelled_runs(px, "part")
    each = spread(again).join(px.select("frame_id", "y", "x", "raw", "ty", "tx"), ["frame_id", "y", "x"])
    boxes = each.groupBy("frame_id", "label").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.min(F.struct("raw", "ty", "tx", "label")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("y0", "x0", "y1", "x1", "o"))
    return each.join(boxes.select("frame_id", "label", rank.cast("int").alias("final")), ["frame_id", "label"]).select("frame_id", "y", "x", "final")


def overlaps(synth: DataFrame, final: DataFrame) -> DataFrame:
    """(frame_id, label, final, n): how many at-floor pixels of a region lie in a final one."""
    return synth.where("label IS NOT NULL").join(final, ["frame_id", "y", "x"]).groupBy("frame_id", "label", "final").agg(F.count("*").alias("n"))


def dispositions(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each provisional region with what became of it, its final regions and its absorbed pixels."""
    by = pairs.groupBy("frame_id", "label").agg(F.array_sort(F.collect_set("final")).alias("final_ids"), F.sum("n").alias("n"))
    t = table.join(by, ["frame_id", "label"], "left")
    hit = F.col("reason") != "not_routed"
    what = F.when(F.col("perimeter"), "perimeter_excluded").when(hit, "routed").when(F.coalesce("n", F.lit(0)) > 0, "absorbed").otherwise("pristine")
    t = t.withColumn("disposition", what)
    none = F.array().cast("array<int>")
    return t.withColumns({"final_ids": F.coalesce("final_ids", none), "absorbed_pixels": F.when(F.col("disposition") == "absorbed", F.col("n")).otherwise(0)}).drop("n")


def final_table(synth: DataFrame, final: DataFrame, disposed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each final region: box, area, the regions routed to it, those absorbed by it, and its pixels that weren't at the floor."""
    px = final.join(synth.select("frame_id", "y", "x", "at_floor"), ["frame_id", "y", "x"])
    t = px.groupBy("frame_id", "final").agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.count("*").alias("area"), F.sum((~F.col("at_floor")).cast("long")).alias("non_floor")
    )
    p = pairs.join(disposed.select("frame_id", "label", "disposition"), ["frame_id", "label"])
    ids = lambda d: F.array_sort(F.collect_set(F.when(F.col("disposition") == d, F.col("label"))))
    by = p.groupBy("frame_id", "final").agg(ids("routed").alias("direct_ids"), ids("absorbed").alias("absorbed_ids"))
    none = F.array().cast("array<int>")
    return t.join(by, ["frame_id", "final"], "left").withColumns({c: F.coalesce(c, none) for c in ("direct_ids", "absorbed_ids")})


def census(synth: DataFrame, disposed: DataFrame) -> DataFrame:
    """Counts of a frame; synth_pixels that aren't routed, absorbed and non-floor ones together raise."""
    n = lambda c: F.sum(c.cast("long"))
    px = synth.groupBy("frame_id").agg(
        F.count("*").alias("frame_pixels"), n(F.col("at_floor")).alias("at_floor_pixels"), n(F.col("synth")).alias("synth_pixels"), n(F.col("synth") & ~F.col("at_floor")).alias("non_floor_pixels"), n(F.col("dilated") & F.col("perimeter")).alias("suppressed_halo_pixels")
    )
    d = lambda x: F.col("disposition") == x
    r = disposed.groupBy("frame_id").agg(
        F.count("*").alias("regions"), n(d("routed")).alias("routed_regions"), n(d("absorbed")).alias("absorbed_regions"), n(d("pristine")).alias("pristine_regions"), n(d("perimeter_excluded")).alias("perimeter_regions"),
        F.sum(F.when(d("routed"), F.col("area")).otherwise(0)).alias("routed_pixels"), F.sum("absorbed_pixels").alias("absorbed_pixels"), F.sum(F.when(d("perimeter_excluded"), F.col("area")).otherwise(0)).alias("perimeter_pixels"),
    )
    c = px.join(r, "frame_id", "left").na.fill(0)
    kept = F.col("synth_pixels") == F.col("routed_pixels") + F.col("absorbed_pixels") + F.col("non_floor_pixels")
    return c.withColumn("synth_pixels", F.when(kept, F.col("synth_pixels")).otherwise(F.raise_error(F.lit("synthesis pixels don't add up")).cast("long")))


def within_budget(c: DataFrame, limit: str = P.ROUTING_MAX_FRACTION) -> DataFrame:
    """within: synth / frame <= limit, compared in integers."""
    f = Fraction(limit)
    return c.withColumn("within", F.col("synth_pixels") * f.denominator <= F.col("frame_pixels") * f.numerator)


def route(mask: DataFrame, limit: str = P.ROUTING_MAX_FRACTION, **policy) -> dict[str, DataFrame]:
    """All tables of a routing: labels, regions, synth, final, finals, census."""
    mask = cut(guarded(mask.select("frame_id", "y", "x", "mask")))
    sizes = {k: policy[k] for k in ("min_area", "min_radius") if k in policy}
    lab = cut(labels(mask))
    table = cut(region_table(mask, lab, **sizes))
    synth = cut(synthesis(mask, lab, table, policy.get("margin", P.ROUTING_MARGIN)))
    final = cut(final_labels(synth))
    pairs = cut(overlaps(synth, final))
    disposed = cut(dispositions(table, pairs))
    return {"labels": lab, "regions": disposed, "synth": synth, "final": final, "pairs": pairs, "finals": final_table(synth, final, disposed, pairs), "census": within_budget(census(synth, disposed), limit)}
