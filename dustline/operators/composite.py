"""Mask-exact compositing: ranges of a crop's context, 8-bit crops for a pluggable fill, decoding, feathered blending.

A fill gets one row for each component and returns one; a crop is bounded by the profile's caps, checked before the first call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions import pixel as X
from dustline.operators.regions import labelled_runs
from dustline.sources.frames import cut

Fill = Callable[[np.ndarray, np.ndarray], np.ndarray]


def boxes(final: DataFrame, size: DataFrame, margin: int = P.CROP_MARGIN) -> DataFrame:
    """Each component's box and crop, half open and clipped to its frame."""
    b = final.groupBy("frame_id", "final").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.count("*").alias("n_pixels"))
    b = b.join(size, "frame_id")
    b = b.withColumns(
        {"cy0": F.greatest(F.lit(0), F.col("y0") - margin), "cx0": F.greatest(F.lit(0), F.col("x0") - margin), "cy1": F.least("h", F.col("y1") + margin), "cx1": F.least("w", F.col("x1") + margin)}
    ).drop("h", "w")
    return b


def preflight(final: DataFrame, box: DataFrame, census: DataFrame | None = None) -> None:
    """Raises before any fill is called: a census over its budget, more components or pixels than the caps, or a component that isn't one 8-connected region.

    Each check is an aggregate of which one row at most comes to the driver.
    """
    if census is not None and census.where("NOT within").limit(1).count():
        raise ValueError("synthesis exceeds a frame's budget")
    crop = (F.col("cy1") - F.col("cy0")).cast("long") * (F.col("cx1") - F.col("cx0"))
    caps = box.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum(crop).alias("total"), F.max(crop).alias("one"))
    if caps.where((F.col("n") > P.MAX_COMPONENTS) | (F.col("total") > P.MAX_TOTAL_CROP) | (F.col("one") > P.MAX_CROP_PIXELS)).limit(1).count():
        raise ValueError("components or crops exceed the caps")
    parts = labelled_runs(final.withColumn("mask", F.lit(True)), "final").groupBy("frame_id", "part").agg(F.countDistinct("label").alias("n"))
    if parts.where("n > 1").limit(1).count():
        raise ValueError("a component isn't one connected region")


def crops(source: DataFrame, box: DataFrame) -> DataFrame:
    """Pixels of every crop. Rows are matched by an equi-join on frame and row of the crop; only columns remain a range."""
    rows = box.withColumn("y", F.explode(F.expr("sequence(cy0, cy1 - 1)")))
    return source.join(rows, ["frame_id", "y"]).where("x >= cx0 AND x < cx1")


def context_ranges(crop: DataFrame) -> DataFrame:
    """Least and greatest sample of each channel over a crop's pixels outside the whole mask; a crop without any raises."""
    out = F.when(~F.col("synth"), 1)
    agg = [F.count(out).alias("n_context")]
    for c in "rgb":
        agg += [F.min(F.when(~F.col("synth"), F.col(c))).alias(f"lo_{c}"), F.max(F.when(~F.col("synth"), F.col(c))).alias(f"hi_{c}")]
    r = crop.groupBy("frame_id", "final").agg(*agg)
    return r.withColumn("n_context", F.when(F.col("n_context") == 0, F.raise_error(F.lit("a crop has no context")).cast("long")).otherwise(F.col("n_context")))


def feather(final: DataFrame, size: DataFrame) -> DataFrame:
    """alpha of component pixels: distance to pixels that aren't of the component, capped at three, by three; the frame's edge is no background.

    A distance is over r if the square of radius r around a pixel, as far as it lies in the frame, is all of its component: counted down columns, then along rows, of
    the component's pixels alone. Components may touch, as those cut on a grid do.
    """
    px = final.join(size, "frame_id").withColumn("distance", F.lit(1))
    inside = lambda at, end, r: F.least(F.col(end) - 1, F.col(at) + r) - F.greatest(F.lit(0), F.col(at) - r) + 1
    for r in range(1, P.FEATHER):
        down = Window.partitionBy("frame_id", "final", "x").orderBy("y").rangeBetween(-r, r)
        along = Window.partitionBy("frame_id", "final", "y").orderBy("x").rangeBetween(-r, r)
        px = px.withColumn("__full", (F.count("*").over(down) == inside("y", "h", r)).cast("int"))
        px = px.withColumn("distance", F.col("distance") + (F.sum("__full").over(along) == inside("x", "w", r)).cast("int"))
    return px.select("frame_id", "y", "x", "final", "distance", (F.col("distance") / float(P.FEATHER)).alias("alpha"))


def mean_fill(rgb8: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A stand-in for a model: the half-up mean of the context of each channel."""
    out = rgb8.copy()
    n = int((~mask).sum())
    for c in range(3):
        total = int(rgb8[..., c][~mask].sum(dtype=np.int64))
        out[..., c][mask] = (2 * total + n) // (2 * n) if n else 0
    return out


def filled(crop: DataFrame, ranges: DataFrame, fill: Fill = mean_fill) -> DataFrame:
    """(frame_id, final, y, x, g8_r, g8_g, g8_b) of component pixels, from one call for each crop. `own` tells which pixels of a crop are its component's."""
    enc = crop.join(ranges, ["frame_id", "final"])
    enc = enc.select("frame_id", "final", "y", "x", "own", *[X.encode8(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")).cast("short").alias(f"e_{c}") for c in "rgb"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        h = int(pdf["y"].max() - pdf["y"].min()) + 1
        rgb = np.stack([pdf[f"e_{c}"].to_numpy(np.uint8).reshape(h, -1) for c in "rgb"], axis=-1)
        mask = pdf["own"].to_numpy(bool).reshape(h, -1)
        made = np.asarray(fill(rgb, mask))
        if made.dtype != np.uint8 or made.shape != rgb.shape:
            raise ValueError("a fill must return uint8 of the crop's shape")
        flat, own = made.reshape(-1, 3), mask.ravel()
        return pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy()[own], "final": pdf["final"].to_numpy()[own], "y": pdf["y"].to_numpy()[own], "x": pdf["x"].to_numpy()[own], **{f"g8_{c}": flat[own, i].astype(np.int32) for i, c in enumerate("rgb")}})

    return enc.groupBy("frame_id", "final").applyInPandas(run, "frame_id string, final int, y int, x int, g8_r int, g8_g int, g8_b int")


def crop_rows(crop: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row for each component, as fills get it: frame_id, final, height, width, rgb8 (row-major bytes) and own (one byte a pixel). Also what an archive of fills keeps."""
    enc = crop.join(ranges, ["frame_id", "final"])
    sample = [F.lpad(F.hex(X.encode8(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))), 2, "0") for c in "rgb"]
    px = F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*sample).alias("v"), F.when(F.col("own"), "01").otherwise("00").alias("o"))))
    rows = enc.groupBy("frame_id", "final").agg((F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"), px.alias("px"))
    text = lambda c: F.unhex(F.array_join(F.transform("px", lambda s: s[c]), ""))
    return rows.select("frame_id", "final", "height", "width", text("v").alias("rgb8"), text("o").alias("own"))


BatchFill = Callable[[list[tuple[np.ndarray, np.ndarray]]], list[np.ndarray]]
FILLED = "frame_id string, final int, height int, width int, rgb8 binary, own binary, made8 binary"


def batch_filled(rows: DataFrame, fill: BatchFill) -> DataFrame:
    """The batch form of the hook: a fill gets the crops of a batch, in order of (frame_id, final), and must return as many. Adds made8; crops in and out stay side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            crops_in = [(np.frombuffer(r.rgb8, np.uint8).reshape(r.height, r.width, 3), np.frombuffer(r.own, np.uint8).reshape(r.height, r.width) == 1) for r in pdf.itertuples()]
            made = list(fill(crops_in))
            if len(made) != len(crops_in):
                raise ValueError("a batch fill must return as many crops as it gets")
            for (rgb, _), m in zip(crops_in, made):
                if np.asarray(m).dtype != np.uint8 or np.asarray(m).shape != rgb.shape:
                    raise ValueError("a fill must return uint8 of the crop's shape")
            yield pdf.assign(made8=[np.ascontiguousarray(m).tobytes() for m in made])

    return rows.repartition("frame_id").sortWithinPartitions("frame_id", "final").mapInPandas(run, FILLED)


def composite(source: DataFrame, synth: DataFrame, final: DataFrame, fill: Fill = mean_fill, margin: int = P.CROP_MARGIN, census: DataFrame | None = None) -> dict[str, DataFrame]:
    """source (frame_id, y, x, r, g, b) with components filled in: boxes, crop, ranges, alpha, made and image. preflight() passes before anything is made."""
    size = source.groupBy("frame_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    box = cut(boxes(final, size, margin))
    preflight(final, box, census)
    px = source.join(synth.select("frame_id", "y", "x", "synth"), ["frame_id", "y", "x"])
    crop = crops(px, box.drop("y0", "x0", "y1", "x1", "n_pixels"))
    crop = crop.join(final.withColumnRenamed("final", "__own"), ["frame_id", "y", "x"], "left").withColumn("own", F.coalesce(F.col("__own") == F.col("final"), F.lit(False))).drop("__own")
    crop = cut(crop)
    ranges = cut(context_ranges(crop))
    alpha = cut(feather(final, size))
    made = filled(crop, ranges, fill).join(ranges, ["frame_id", "final"]).join(alpha.select("frame_id", "y", "x", "alpha"), ["frame_id", "y", "x"])
    made = made.select("frame_id", "y", "x", "alpha", *[X.decode16(F.col(f"g8_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}")).alias(f"m_{c}") for c in "rgb"])
    image = source.join(made, ["frame_id", "y", "x"], "left")
    image = image.select("frame_id", "y", "x", *[F.when(F.col("alpha").isNull(), F.col(c)).otherwise(X.blend(F.col(c), F.col(f"m_{c}"), F.col("alpha"))).alias(c) for c in "rgb"])
    return {"boxes": box, "crop": crop, "ranges": ranges, "alpha": alpha, "made": made, "image": image}


def outside_changes(before: DataFrame, after: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels that aren't in the mask and yet differ: none, if compositing is right."""
    both = before.join(after.select("frame_id", "y", "x", *[F.col(c).alias(f"a_{c}") for c in "rgb"]), ["frame_id", "y", "x"], "full")
    differs = ~(F.col("r").eqNullSafe(F.col("a_r")) & F.col("g").eqNullSafe(F.col("a_g")) & F.col("b").eqNullSafe(F.col("a_b")))
    return both.where(differs).join(mask.where("synth").select("frame_id", "y", "x"), ["frame_id", "y", "x"], "left_anti")
