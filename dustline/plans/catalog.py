"""Queries over the driver's tables, one for each operator, and SQL that DuckDB runs for the same rows.

Single-precision results are widened in both, which keeps every bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.functions import pixel as X
from dustline.operators import analysis, banded, composite, prepass, regions, stencil, writer
from dustline.plans import receipts
from dustline.plans import repair as R
from dustline.plans.sqltext import FLOOR, dbl, index, inverse, resp, sql
from dustline.sources import frames, integrity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


def dd(*cols: str):
    return [F.col(c).cast("double").alias(c) for c in cols]


def ds(*cols: str) -> str:
    return ", ".join(f"{c}::DOUBLE AS {c}" for c in cols)


def px(spark, sf):
    return frames.events_frame(spark, sf)


def scored(spark, sf):
    return frames.cut(analysis.analysed(px(spark, sf)))


def decided(spark, sf):
    return analysis.eligible(analysis.decision(scored(spark, sf)))


def latched(spark, sf):
    return analysis.latch(analysis.working(px(spark, sf)))


def mask(spark, sf):
    return frames.cut(scored(spark, sf).select("frame_id", "y", "x", X.at_floor(F.col("score")).alias("mask")))


def feat(spark, sf):
    return stencil.features(stencil.averages(stencil.vertical(stencil.padded(scored(spark, sf)))), F.lit(0.0).cast("float"))


# point-wise
@query("response_lut", f"SELECT v::INT AS v, {resp('v')}::DOUBLE AS response FROM range(0, 65536) t(v)")
def _(spark, sf):
    return spark.range(65536).select(F.col("id").cast("int").alias("v"), X.response(F.col("id")).cast("double").alias("response"))


@query("response_convert", sql(f"SELECT y, x, {ds('wr', 'wg', 'wb', 'wi')} FROM work", "work"))
def _(spark, sf):
    return analysis.working(px(spark, sf)).select("y", "x", *dd("wr", "wg", "wb", "wi"))


@query("per_channel_response", sql(f"SELECT y, x, {resp('r')}::DOUBLE AS wr, ((g * 2)::FLOAT)::DOUBLE AS wg, ((b + 1)::FLOAT)::DOUBLE AS wb, ((65535 - ir)::FLOAT)::DOUBLE AS wi FROM px", "px"))
def _(spark, sf):
    v = F.col("id")
    tables = spark.range(65536).select(v.cast("int").alias("v"), X.response(v).alias("tr"), (v * 2).cast("float").alias("tg"), (v + 1).cast("float").alias("tb"), (65535 - v).cast("float").alias("ti"))
    return analysis.per_channel_response(px(spark, sf), tables).select("y", "x", *dd("wr", "wg", "wb", "wi"))


@query("linear_response", sql("SELECT y, x, (r::FLOAT * 0.5::FLOAT + 16.0::FLOAT)::DOUBLE AS v FROM px", "px"))
def _(spark, sf):
    return px(spark, sf).select("y", "x", X.linear_response(F.col("r"), 0.5, 16.0).cast("double").alias("v"))


@query("inverse_response", f"SELECT i::INT AS i, {inverse('i')} AS v FROM range(0, 65536) t(i)")
def _(spark, sf):
    i = F.col("id").cast("int")
    return spark.range(65536).select(i.alias("i"), X.inverse_response(i).alias("v"))


@query("work_index", sql(f"SELECT y, x, {index('aux * 1.5::FLOAT - 10000.0::FLOAT')} AS i FROM aux", "aux"))
def _(spark, sf):
    return scored(spark, sf).select("y", "x", X.work_index(F.col("aux") * F.lit(1.5).cast("float") - F.lit(10000.0).cast("float")).alias("i"))


@query("emit_rgb16", sql("SELECT y, x, " + ", ".join(f"{inverse(index('w' + c))} AS {c}" for c in "rgb") + " FROM work", "work"))
def _(spark, sf):
    return analysis.working(px(spark, sf)).select("y", "x", *[X.emit(F.col(f"w{c}")).alias(c) for c in "rgb"])


@query("auxiliary_plane", sql(f"SELECT y, x, {ds('aux')} FROM aux", "aux"))
def _(spark, sf):
    return scored(spark, sf).select("y", "x", *dd("aux"))


@query("auxiliary_alpha_one", sql("SELECT y, x, CASE WHEN y % 2 = 0 THEN 41234.5::DOUBLE ELSE ((wi::DOUBLE - 0.25::DOUBLE * wr::DOUBLE) / 0.75::DOUBLE - 1.0::DOUBLE)::FLOAT::DOUBLE END AS aux FROM work", "work"))
def _(spark, sf):
    alpha = F.when(F.col("y") % 2 == 0, 1.0).otherwise(0.25)
    return analysis.working(px(spark, sf)).select("y", "x", X.auxiliary(F.col("wi"), F.col("wr"), alpha, F.lit(41234.5)).cast("double").alias("aux"))


@query("score_plane", sql(f"SELECT y, x, {ds('score')} FROM scored", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("y", "x", *dd("score"))


@query("weighted_planes", sql(f"SELECT y, x, {ds('sa', 'sr', 'sg', 'sb')} FROM scored", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("y", "x", *dd("sa", "sr", "sg", "sb"))


@query("at_floor_rows", sql(f"SELECT y, sum((score = {FLOOR})::INT)::BIGINT AS at_floor, sum((score = 1)::INT)::BIGINT AS full_score, count(*) AS pixels FROM scored GROUP BY y", "scored"))
def at_floor_rows(spark, sf):
    n = lambda c: F.sum(c.cast("long"))
    return scored(spark, sf).groupBy("y").agg(n(X.at_floor(F.col("score"))).alias("at_floor"), n(F.col("score") == 1).alias("full_score"), F.count("*").alias("pixels"))


# decision
@query("decision_bars", sql("SELECT y, x, max(edged) FILTER (bar = 0) AS bar0, max(edged) FILTER (bar = 1) AS bar1, max(edged) FILTER (bar = 2) AS bar2, max(edged) FILTER (bar = 3) AS bar3 FROM bars GROUP BY y, x", "bars"))
def _(spark, sf):
    return analysis.decision(scored(spark, sf)).select("y", "x", "bar0", "bar1", "bar2", "bar3")


@query("decision_boundary_replicate", sql("SELECT y, x, fallback, boundary FROM decided", "decided"))
def _(spark, sf):
    return analysis.decision(scored(spark, sf)).select("y", "x", "fallback", "boundary")


@query("decision_boundary_fallback", sql("SELECT y, x, strict AS fallback, boundary FROM decided", "decided"))
def _(spark, sf):
    return analysis.decision(scored(spark, sf), "fallback").select("y", "x", "fallback", "boundary")


@query("group_fallback", "SELECT vec_id, len(list_filter(range(0, 7), lambda g: len(list_filter(embedding[9 * g + 1:9 * g + 9], lambda v: v < 0.0::FLOAT)) > 6)) > 0 AS fallback FROM embeddings")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    groups = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda g: F.slice("embedding", g * 9 + 1, 9))
    return e.select("vec_id", analysis.group_fallback(groups, 0.0, 6).alias("fallback"))


@query("eligibility", sql("SELECT y, x, eligible FROM eligible", "eligible"))
def _(spark, sf):
    return decided(spark, sf).select("y", "x", "eligible")


# producer
@query("producer_latch", sql("SELECT y, x, accepted FROM latch", "latch"))
def _(spark, sf):
    return latched(spark, sf).select("y", "x", "accepted")


@query("producer_row_sums", sql("SELECT y, visible, infrared, weight, n_accepted FROM sums", "sums"))
def _(spark, sf):
    return analysis.row_sums(latched(spark, sf)).select("y", "visible", "infrared", "weight", "n_accepted")


@query("producer_cumulative_means", sql("SELECT y, tv, ti, tw, mv::DOUBLE AS mv, mi::DOUBLE AS mi FROM means", "means"))
def _(spark, sf):
    m = analysis.cumulative_means(analysis.row_sums(latched(spark, sf)))
    return m.select("y", F.col("t_visible").alias("tv"), F.col("t_infrared").alias("ti"), F.col("t_weight").alias("tw"), F.col("mean_visible").cast("double").alias("mv"), F.col("mean_infrared").cast("double").alias("mi"))


@query("producer_quadrants", sql("SELECT band::INT AS band, cell::INT AS cell, q::INT AS q, dv::DOUBLE AS dv, di::DOUBLE AS di, raw FROM quads", "quads"))
def _(spark, sf):
    return analysis.quadrants(latched(spark, sf)).select("band", "cell", "q", *dd("dv", "di"), "raw")


@query("producer_scale_epochs", sql("SELECT band::INT AS band, add_den::DOUBLE AS add_den, add_num::DOUBLE AS add_num FROM epochs", "epochs"))
def _(spark, sf):
    return analysis.scale_epochs(analysis.quadrants(latched(spark, sf))).select("band", *dd("add_den", "add_num"))


@query("row_calibration", sql("SELECT y, p1::DOUBLE AS p1, p2::DOUBLE AS p2, alpha::DOUBLE AS alpha, base::DOUBLE AS base, gate2, base_score::DOUBLE AS base_score, base_write::DOUBLE AS base_write FROM cal", "cal"))
def _(spark, sf):
    return analysis.calibration(latched(spark, sf)).select("y", *dd("p1", "p2", "alpha", "base"), "gate2", *dd("base_score", "base_write"))


@query("prepass_tiles", sql("SELECT ty::INT AS ty, tx::INT AS tx, n_valid, raw FROM ptile", "ptile"))
def _(spark, sf):
    return prepass.tiles(frames.prepass_frame(px(spark, sf))).select("ty", "tx", "n_valid", "raw")


@query("prepass_sums", sql("SELECT n AS valid_pixels, sr AS sum_visible, si AS sum_infrared, s2 AS sum_weight, (sr / s2)::FLOAT::DOUBLE AS mean_visible, (si / s2)::FLOAT::DOUBLE AS mean_infrared FROM psum", "psum"))
def _(spark, sf):
    return prepass.records(frames.prepass_frame(px(spark, sf))).select("valid_pixels", "sum_visible", "sum_infrared", "sum_weight", *dd("mean_visible", "mean_infrared"))


@query("prepass_alpha", sql(f"SELECT 'main' AS frame_id, full_tiles, {ds('alpha', 'alpha_scaled')}, den::DOUBLE AS regression_den, num::DOUBLE AS regression_num, ((mi::DOUBLE - alpha::DOUBLE * mv::DOUBLE) / (1.0::DOUBLE - alpha::DOUBLE))::FLOAT::DOUBLE AS base, {P.PREPASS_MARKER} AS marker FROM prec", "prec"))
def _(spark, sf):
    r = prepass.base_primary(prepass.records(frames.prepass_frame(px(spark, sf))))
    return r.select("frame_id", "full_tiles", *dd("alpha", "alpha_scaled", "regression_den", "regression_num", "base"), "marker")


@query("prepass_record_bytes")
def _(spark, sf):
    return prepass.record_bytes(prepass.records(frames.prepass_frame(px(spark, sf)))).select("frame_id", F.hex("record").alias("record"))


@query("acquisition_pairs", "SELECT o_custkey AS same_frame_id, o_orderkey::VARCHAR AS prepass_id, l_orderkey || '/' || l_linenumber AS main_id FROM orders JOIN lineitem ON l_suppkey = o_custkey WHERE o_orderstatus <> 'P'")
def _(spark, sf):
    """Orders stand for prepasses (those of status P for captures of a wrong epoch), lineitems for main captures."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("same_frame_id"), F.col("o_orderkey").cast("string").alias("frame_id"), F.when(F.col("o_orderstatus") == "P", "main").otherwise("prepass").alias("epoch"))
    m = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("same_frame_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("frame_id"), F.lit("main").alias("epoch"))
    return prepass.paired(o, m).select("same_frame_id", "prepass_id", "main_id")


# neighbourhoods
_V = [f"{p}_{n}" for p in ("score", "sa", "sr") for n in ("3", "5", "7", "9", "b")]


@query("vertical_scratch", sql(f"SELECT y, x, {ds(*_V)} FROM vertical", "vertical"))
def _(spark, sf):
    return stencil.vertical(stencil.padded(scored(spark, sf))).select("y", "x", *dd(*_V))


_A = [f"{p}_q{n}" for p in stencil.PLANES for n in ("69", "21", "16")]


@query("spatial_averages", sql(f"SELECT y, x, {', '.join(_A)} FROM averages WHERE y BETWEEN -1 AND (SELECT h FROM dims)", "averages", "dims"))
def _(spark, sf):
    a = stencil.averages(stencil.vertical(stencil.padded(scored(spark, sf))))
    h = F.max(F.when(~F.col("pad"), F.col("y"))).over(Window.partitionBy("frame_id", "x")) + 1
    return a.withColumn("h", h).where("y <= h").select("y", "x", *_A)


@query("weight_records", sql(f"SELECT y, x, {ds('W69', 'W21', 'W16', 'W1')} FROM features WHERE NOT pad AND y BETWEEN 4 AND (SELECT h - 5 FROM dims) AND x BETWEEN 4 AND 95", "features", "dims"))
def _(spark, sf):
    f = feat(spark, sf)
    h = F.max(F.when(~F.col("pad"), F.col("y"))).over(Window.partitionBy("frame_id", "x")) + 1
    return f.withColumn("h", h).where("y >= 4 AND y < h - 4 AND x >= 4 AND x < 96").select("y", "x", *dd("W69", "W21", "W16", "W1"))


@query("feature_records", sql(f"SELECT y, x, {ds('A69', 'A21', 'A16', 'A1')} FROM features WHERE NOT pad", "features"))
def _(spark, sf):
    return feat(spark, sf).where("NOT pad").select("y", "x", *dd("A69", "A21", "A16", "A1"))


_R = ("lo0", "hi0", "lo1", "hi1", "lo2", "hi2")


@query("band_ranges", sql(f"SELECT y, x, {ds(*_R)} FROM ranges WHERE NOT pad", "ranges"))
def _(spark, sf):
    return stencil.band_ranges(feat(spark, sf)).where("NOT pad").select("y", "x", *dd(*_R))


@query("band_ranges_centre", sql("SELECT y, x, (A21::DOUBLE - A69::DOUBLE)::FLOAT::DOUBLE AS lo0, (A16::DOUBLE - A21::DOUBLE)::FLOAT::DOUBLE AS lo1, (A1::DOUBLE - A16::DOUBLE)::FLOAT::DOUBLE AS hi2 FROM features WHERE NOT pad", "features"))
def _(spark, sf):
    return stencil.band_ranges(feat(spark, sf), cross=False).where("NOT pad").select("y", "x", *dd("lo0", "lo1", "hi2"))


_C = [f"C{n}{c}" for c in "rgb" for n in (69, 21, 16)]


@query("rgb_candidates", sql(f"SELECT y, x, {ds(*_C)} FROM candidates", "candidates"))
def _(spark, sf):
    return stencil.candidates(feat(spark, sf)).where("NOT pad").select("y", "x", *dd(*_C))


@query("combined_candidate", sql("SELECT y, x, kr, kg, kb FROM combined", "combined"))
def _(spark, sf):
    s = scored(spark, sf)
    return stencil.reconstruction(s, analysis.eligible(analysis.decision(s))).select("y", "x", "kr", "kg", "kb")


@query("combined_candidate_banded", SQL["combined_candidate"])
def _(spark, sf):
    s = scored(spark, sf)
    return banded.reconstruction(s, analysis.eligible(analysis.decision(s))).select("y", "x", "kr", "kg", "kb")


_K3 = [(dy, dx, w) for dy, dx, w in ((-1, 0, 0.25), (0, -1, 0.5), (0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.25))]


def _kernel_sql() -> str:
    s = [f"(coalesce({f'lag(score, {-dx})' if dx < 0 else f'lead(score, {dx})'} OVER r, 0) * {w}::FLOAT)" if dy == 0 and dx else f"(coalesce({f'lag(score, {-dy})' if dy < 0 else f'lead(score, {dy})'} OVER c, 0) * {w}::FLOAT)" if dy else f"(score * {w}::FLOAT)" for dy, dx, w in _K3]
    v = [f"coalesce({f'lag(aux, {-dx})' if dx < 0 else f'lead(aux, {dx})'} OVER r, 0)" if dy == 0 and dx else f"coalesce({f'lag(aux, {-dy})' if dy < 0 else f'lead(aux, {dy})'} OVER c, 0)" if dy else "aux" for dy, dx, w in _K3]
    num, den = "0.0::FLOAT", "0.0::FLOAT"
    for a, b in zip(s, v):
        num, den = f"({num} + ({a} * {b})::FLOAT)::FLOAT", f"({den} + {a})::FLOAT"
    step = f"SELECT y, x, {num} AS num, {den} AS den FROM scored WINDOW c AS (PARTITION BY x ORDER BY y), r AS (PARTITION BY y ORDER BY x)"
    return f"SELECT y, x, num::DOUBLE AS num, den::DOUBLE AS den, (CASE WHEN den > 0 THEN num / den ELSE num END)::FLOAT::DOUBLE AS candidate FROM ({step})"


@query("kernel_candidate", sql(_kernel_sql(), "scored"))
def _(spark, sf):
    return stencil.kernel_candidate(scored(spark, sf), _K3).select("y", "x", *dd("num", "den", "candidate"))


@query("dead_zone", "SELECT vec_id, p::INT AS pos, (CASE WHEN v < -0.1::FLOAT THEN v - -0.1::FLOAT WHEN v > 0.05::FLOAT THEN v - 0.05::FLOAT ELSE 0::FLOAT END)::DOUBLE AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding) AS v FROM embeddings)")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select("vec_id", "pos", X.dead_zone(F.col("v"), F.lit(-0.1), F.lit(0.05)).cast("double").alias("v"))


def _zone(v: str) -> str:
    return f"(CASE WHEN {v} < -0.05::FLOAT THEN {v} - -0.05::FLOAT WHEN {v} > 0.05::FLOAT THEN {v} - 0.05::FLOAT ELSE 0.0::FLOAT END)"


@query("band_combiner", f"SELECT vec_id, p::INT AS pos, (e[4 * p + 1] + {_zone('(e[4 * p + 2] - e[4 * p + 1])')} * 1.0::FLOAT + {_zone('(e[4 * p + 3] - e[4 * p + 2])')} * 0.5::FLOAT + {_zone('(e[4 * p + 4] - e[4 * p + 3])')} * 0.25::FLOAT)::DOUBLE AS v FROM (SELECT vec_id, embedding AS e, unnest(range(0, 16)) AS p FROM embeddings)")
def _(spark, sf):
    """Every four components of a vector stand for three averages and a source."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    e = e.select("vec_id", "pos", *[F.element_at("embedding", F.col("pos") * 4 + i + 1).alias(n) for i, n in enumerate("abcs")])
    lim = [(F.lit(-0.05), F.lit(0.05))] * 3
    return e.select("vec_id", "pos", X.combine_bands(*[F.col(c) for c in "abcs"], lim, (1.0, 0.5, 0.25)).cast("double").alias("v"))


# random sequence and writer
@query("lcg_sequence", f"WITH RECURSIVE s AS (SELECT 0 AS n, {P.LCG_SEED}::BIGINT AS state UNION ALL SELECT n + 1, (state * 125 + 1) & {P.LCG_MASK} FROM s WHERE n < 999) SELECT n::BIGINT AS n, state::INT AS state, (state::DOUBLE + 1.0::DOUBLE) * {dbl(P.LCG_UNIT)} - 0.5::DOUBLE AS unit FROM s")
def _(spark, sf):
    s = spark.range(1000).select(F.col("id").alias("n"), X.lcg_jump(F.lit(P.LCG_SEED), F.col("id")).alias("state"))
    return s.withColumn("unit", X.lcg_unit(F.col("state")))


@query("lcg_jump", "SELECT * FROM (VALUES (34596507::BIGINT, 8880392::INT), (36383248::BIGINT, 16418997::INT)) t(n, state)")
def _(spark, sf):
    return spark.createDataFrame([(34596507,), (36383248,)], "n bigint").select("n", X.lcg_jump(F.lit(P.LCG_SEED), F.col("n") % (1 << 24)).alias("state"))


@query("dither_bounds", f"SELECT i::INT AS i, {resp('i')}::DOUBLE AS v FROM (VALUES (655), (64879)) t(i)")
def _(spark, sf):
    low, high = X.percentile_indices(65535)
    return spark.createDataFrame([(low,), (high,)], "i int").select("i", X.response(F.col("i")).cast("double").alias("v"))


@query("startup_rows")
def _(spark, sf):
    return R.stages(px(spark, sf))["starts"]


@query("writer_rows_from_seed", sql(f"SELECT y, x, {ds('vr', 'vg', 'vb')}, draws, state::INT AS state FROM written, ends", "written", "ends"))
def _(spark, sf):
    return R.stages(px(spark, sf), hidden=False)["values"].select("y", "x", *dd("vr", "vg", "vb"), "draws", "state")


@query("writer_rows")
def _(spark, sf):
    return R.stages(px(spark, sf))["values"].select("y", "x", *dd("vr", "vg", "vb"), "draws", "state")


@query("replay_counters_from_seed", sql("SELECT 'main' AS frame_id, count(*) AS pixels, sum(attempted::INT)::BIGINT AS attempted_pixels, sum(written::INT)::BIGINT AS written_pixels, sum(changed::INT)::BIGINT AS changed_pixels FROM output", "output"))
def _(spark, sf):
    return writer.counters(R.repair(px(spark, sf), hidden=False))


@query("replay_counters")
def _(spark, sf):
    return writer.counters(R.repair(px(spark, sf)))


@query("repair_image_from_seed", sql("SELECT 'main' AS frame_id, y, x, r, g, b, attempted, written, changed FROM output", "output"))
def _(spark, sf):
    return R.repair(px(spark, sf), hidden=False)


@query("repair_image")
def _(spark, sf):
    return R.repair(px(spark, sf))


@query("repair_content_hash_from_seed", sql("SELECT 'main' AS frame_id, sha256(unhex(string_agg(printf('%02x%02x', r & 255, r >> 8) || printf('%02x%02x', g & 255, g >> 8) || printf('%02x%02x', b & 255, b >> 8), '' ORDER BY y, x))) AS sha256 FROM output", "output"))
def _(spark, sf):
    return frames.content_hash(R.repair(px(spark, sf), hidden=False))


@query("repair_content_hash")
def _(spark, sf):
    return frames.content_hash(R.repair(px(spark, sf)))


@query("engine_parity", sql("SELECT y, x, kr, kg, kb, kr AS jr, kg AS jg, kb AS jb FROM combined", "combined"))
def _(spark, sf):
    """Both engines' candidates side by side, from a full join."""
    s = scored(spark, sf)
    e = analysis.eligible(analysis.decision(s))
    a, b = stencil.reconstruction(s, e), banded.reconstruction(s, e)
    both = a.select("frame_id", "y", "x", "kr", "kg", "kb").join(b.select("frame_id", "y", "x", *[F.col(f"k{c}").alias(f"j{c}") for c in "rgb"]), ["frame_id", "y", "x"], "full")
    return both.drop("frame_id")


@query("render_route", sql("SELECT y, x, (CASE WHEN NOT (ir < 1000) AND score < 1 THEN sr ELSE wr END)::DOUBLE AS v FROM scored", "scored"))
def _(spark, sf):
    s = scored(spark, sf)
    return s.select("y", "x", analysis.render(s, F.col("ir") < 1000, F.col("wr"), F.col("sr"), F.col("score") < 1).cast("double").alias("v"))


# blocks
@query("block_split", sql("SELECT (y // 8)::INT AS block, min(y) AS start_row, max(y) - min(y) + 1 AS valid_rows, max(x) + 1 AS width, count(*) AS n, sum(r)::BIGINT AS sum_r FROM px GROUP BY y // 8", "px"))
def _(spark, sf):
    b = frames.split_blocks(px(spark, sf), 8)
    return b.select("block", "start_row", "valid_rows", "width", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda s, v: s + v["r"]).alias("sum_r"))


@query("block_assemble_gaps", sql("SELECT block, start_row - coalesce(lag(last_row + 1) OVER (ORDER BY start_row), 0) AS gap FROM (SELECT (y // 8)::INT AS block, min(y) AS start_row, max(y) AS last_row FROM px WHERE y // 8 % 3 <> 1 GROUP BY y // 8)", "px"))
def _(spark, sf):
    """Every third block is missing, so there are gaps to find."""
    return frames.block_gaps(frames.split_blocks(px(spark, sf).where("y div 8 % 3 <> 1"), 8)).select("block", "gap")


@query("block_assemble", sql("SELECT y, x, r, g, b, ir FROM px", "px"))
def _(spark, sf):
    return frames.assemble_blocks(frames.split_blocks(px(spark, sf), 8)).select("y", "x", "r", "g", "b", "ir")


# regions
@query("region_labels", sql("SELECT y, x, label FROM labels", "labels"))
def _(spark, sf):
    return regions.labels(mask(spark, sf)).select("y", "x", "label")


_T = "label, y0, x0, y1, x1, area, radius, reason, perimeter"


@query("region_table", sql(f"SELECT {_T} FROM regions", "regions"))
def _(spark, sf):
    m = mask(spark, sf)
    return regions.region_table(m, regions.labels(m)).select(*_T.split(", "))


@query("chessboard_distance", sql("SELECT y, x, distance FROM dist", "dist"))
def _(spark, sf):
    m = mask(spark, sf)
    return regions.distances(regions.labels(m), regions.frame_sizes(m)).select("y", "x", "distance")


@query("dilate_mask", sql("SELECT m.y, m.x, EXISTS (SELECT 1 FROM mask n WHERE n.mask AND abs(n.y - m.y) <= 4 AND abs(n.x - m.x) <= 4) AS dilated FROM mask m", "mask"))
def _(spark, sf):
    return regions.dilate(mask(spark, sf), "mask").select("y", "x", "dilated")


@query("perimeter_component", sql("SELECT count(*) AS n FROM regions WHERE perimeter", "regions"))
def _(spark, sf):
    m = mask(spark, sf)
    return regions.region_table(m, regions.labels(m)).agg(F.sum(F.col("perimeter").cast("long")).alias("n"))


@query("synthesis_mask", sql("SELECT y, x, at_floor, synth FROM synth", "synth"))
def _(spark, sf):
    return regions.route(mask(spark, sf))["synth"].select("y", "x", "at_floor", "synth")


@query("final_regions", sql("SELECT f.y, f.x, f.final FROM final f", "final"))
def _(spark, sf):
    return regions.route(mask(spark, sf))["final"].select("y", "x", "final")


@query("overlap_pairs", sql("SELECT label, final, n FROM pairs", "pairs"))
def _(spark, sf):
    return regions.route(mask(spark, sf))["pairs"].select("label", "final", "n")


@query("region_disposition", sql("SELECT label, reason, disposition, array_to_string(final_ids, ',') AS final_ids, absorbed_pixels FROM disposed", "disposed"))
def _(spark, sf):
    r = regions.route(mask(spark, sf))["regions"]
    return r.select("label", "reason", "disposition", F.array_join(F.col("final_ids").cast("array<string>"), ",").alias("final_ids"), F.col("absorbed_pixels").cast("long").alias("absorbed_pixels"))


@query(
    "final_region_table",
    sql(
        """SELECT final, y0, x0, y1, x1, area, non_floor, coalesce(direct_ids, '') AS direct_ids, coalesce(absorbed_ids, '') AS absorbed_ids FROM (
        SELECT final, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS area, sum((NOT at_floor)::INT)::BIGINT AS non_floor FROM final JOIN synth USING (y, x) GROUP BY final)
        LEFT JOIN (SELECT final, string_agg(label, ',' ORDER BY label) FILTER (disposition = 'routed') AS direct_ids, string_agg(label, ',' ORDER BY label) FILTER (disposition = 'absorbed') AS absorbed_ids FROM pairs JOIN disposed USING (label) GROUP BY final) USING (final)""",
        "final", "synth", "pairs", "disposed",
    ),
)
def _(spark, sf):
    f = regions.route(mask(spark, sf))["finals"]
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return f.select("final", "y0", "x0", "y1", "x1", "area", "non_floor", text("direct_ids"), text("absorbed_ids"))


_CENSUS = """SELECT (SELECT count(*) FROM synth) AS frame_pixels, (SELECT count(*) FROM synth WHERE at_floor) AS at_floor_pixels, (SELECT count(*) FROM synth WHERE synth) AS synth_pixels,
(SELECT count(*) FROM synth WHERE synth AND NOT at_floor) AS non_floor_pixels, (SELECT count(*) FROM disposed) AS regions, (SELECT count(*) FROM disposed WHERE disposition = 'routed') AS routed_regions,
(SELECT count(*) FROM disposed WHERE disposition = 'absorbed') AS absorbed_regions, (SELECT coalesce(sum(area), 0)::BIGINT FROM disposed WHERE disposition = 'routed') AS routed_pixels,
(SELECT coalesce(sum(absorbed_pixels), 0)::BIGINT FROM disposed) AS absorbed_pixels"""


@query("routing_census", sql(_CENSUS, "synth", "disposed"))
def _(spark, sf):
    c = regions.route(mask(spark, sf))["census"]
    return c.select("frame_pixels", "at_floor_pixels", "synth_pixels", "non_floor_pixels", "regions", "routed_regions", "absorbed_regions", "routed_pixels", F.col("absorbed_pixels").cast("long").alias("absorbed_pixels"))


@query("synthesis_budget", sql("SELECT l AS allowed, (SELECT count(*) FROM synth WHERE synth) * d <= (SELECT count(*) FROM synth) * n AS within FROM (VALUES ('0.02', 100, 2), ('0.15', 100, 15), ('1.0', 1, 1)) t(l, d, n)", "synth"))
def _(spark, sf):
    c = regions.route(mask(spark, sf))["census"]
    parts = [regions.within_budget(c, limit).select(F.lit(limit).alias("allowed"), "within") for limit in ("0.02", "0.15", "1.0")]
    return parts[0].union(parts[1]).union(parts[2])


@query("routing_document")
def _(spark, sf):
    r = regions.route(mask(spark, sf))
    c = r["census"].select(F.to_json(F.struct(*sorted(x for x in r["census"].columns if x != "frame_id"))).alias("census"), "frame_id")
    reg = r["regions"].groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("id"), "area", F.array("y0", "x0", "y1", "x1").alias("bbox"), "disposition", "radius", "reason"))).alias("regions"))
    return c.join(reg, "frame_id", "left").select("frame_id", "census", F.to_json(F.struct("regions")).alias("regions"))


# compositing
#: The made-up frame holds far more to synthesise than a film scan, so its budget is larger than the profile's.
LIMIT = "0.9"


def _composite(spark, sf):
    r = regions.route(mask(spark, sf), LIMIT)
    return r, composite.composite(px(spark, sf).select("frame_id", "y", "x", "r", "g", "b"), r["synth"], r["final"], census=r["census"])


_CTX = "final, n_context, lo_r, hi_r, lo_g, hi_g, lo_b, hi_b"


@query("crop_boxes", sql("SELECT final, y0, x0, y1, x1, n_pixels, cy0, cx0, cy1, cx1 FROM boxes", "boxes"))
def _(spark, sf):
    return _composite(spark, sf)[1]["boxes"].drop("frame_id")


@query("crop_context_ranges", sql(f"SELECT {_CTX} FROM context", "context"))
def _(spark, sf):
    return _composite(spark, sf)[1]["ranges"].select(*_CTX.split(", "))


@query("affine_encode", sql("SELECT y, x, (CASE WHEN x = 0 THEN 0 ELSE least(greatest(floor((r - 30000)::DOUBLE * 255.0::DOUBLE / 3000.0::DOUBLE + 0.5::DOUBLE), 0), 255) END)::INT AS e FROM px", "px"))
def _(spark, sf):
    return px(spark, sf).select("y", "x", X.encode8(F.col("r"), F.lit(30000), F.when(F.col("x") == 0, 30000).otherwise(33000)).alias("e"))


@query("affine_decode", "SELECT v::INT AS v, least(greatest(floor(1000.0::DOUBLE + v::DOUBLE * 61234.0::DOUBLE / 255.0::DOUBLE + 0.5::DOUBLE), 0), 65535)::INT AS d FROM range(0, 256) t(v)")
def _(spark, sf):
    return spark.range(256).select(F.col("id").cast("int").alias("v"), X.decode16(F.col("id"), F.lit(1000), F.lit(62234)).alias("d"))


@query("feather_alpha", sql("SELECT y, x, final, distance, alpha FROM feather", "feather"))
def _(spark, sf):
    return _composite(spark, sf)[1]["alpha"].select("y", "x", "final", "distance", "alpha")


@query("composite_blend", sql("SELECT y, x, r, g, b FROM image", "image"))
def _(spark, sf):
    return _composite(spark, sf)[1]["image"].select("y", "x", "r", "g", "b")


@query("alpha_range", sql("SELECT final, min(alpha) AS alpha_min, max(alpha) AS alpha_max FROM feather GROUP BY final", "feather"))
def _(spark, sf):
    return _composite(spark, sf)[1]["alpha"].groupBy("final").agg(F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"))


@query("outside_mask_identity", sql("SELECT p.y, p.x, p.r, p.g, p.b, 0::BIGINT AS n FROM px p JOIN synth s USING (y, x) WHERE NOT s.synth", "px", "synth"))
def _(spark, sf):
    """Pixels outside the mask as the composite has them, and how many outside_changes() finds."""
    r, c = _composite(spark, sf)
    n = composite.outside_changes(px(spark, sf).select("frame_id", "y", "x", "r", "g", "b"), c["image"], r["synth"]).agg(F.count("*").alias("n"))
    return c["image"].join(r["synth"].where("NOT synth").select("frame_id", "y", "x"), ["frame_id", "y", "x"]).select("y", "x", "r", "g", "b").crossJoin(F.broadcast(n))  # n is one row


def _caps_sql(n: str, cases: list[tuple[str, bool]]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f"('{c}', {str(v).lower()})" for c, v in cases)}) t({n}, refused)"


def _refused(f, *kinds) -> bool:
    try:
        f()
    except kinds or (ValueError,):
        return True
    return False


@query("composite_caps", _caps_sql("cap", [("as it is", False), ("components", True), ("crop", True), ("all crops", True), ("budget", True), ("two regions", True)]))
def _(spark, sf):
    """What preflight refuses: caps under what the frame needs, a budget that is exceeded, a component of two regions."""
    from unittest.mock import patch

    r = regions.route(mask(spark, sf), LIMIT)
    final, box = r["final"], frames.cut(composite.boxes(r["final"], regions.frame_sizes(px(spark, sf))))
    run = lambda name=None, final=final, census=r["census"]: _refused(lambda: composite.preflight(final, box, census)) if name is None else _with(patch, name, lambda: composite.preflight(final, box, census))
    rows = [("as it is", run()), ("components", run("MAX_COMPONENTS")), ("crop", run("MAX_CROP_PIXELS")), ("all crops", run("MAX_TOTAL_CROP"))]
    rows.append(("budget", run(census=regions.within_budget(r["census"].drop("within"), "0.0001"))))
    apart = final.where("y % 7 <> 3").withColumn("final", F.lit(1))
    return spark.createDataFrame([*rows, ("two regions", run(final=apart))], "cap string, refused boolean")


def _with(patch, name, f) -> bool:
    with patch.object(P, name, 0):
        return _refused(f)


@query("tiled_feather", sql("SELECT y, x, part AS final, least(3, min(d))::INT AS distance FROM (SELECT s.y, s.x, s.part, greatest(abs(s.y - m.y), abs(s.x - m.x)) AS d FROM (SELECT y, x, ((y // 9) * 1000 + x // 9)::INT AS part FROM synth WHERE synth) s JOIN synth m ON abs(s.y - m.y) <= 3 AND abs(s.x - m.x) <= 3 WHERE NOT m.synth OR (m.y // 9) * 1000 + m.x // 9 <> s.part UNION ALL SELECT y, x, ((y // 9) * 1000 + x // 9)::INT, 3 FROM synth WHERE synth) GROUP BY ALL", "synth"))
def _(spark, sf):
    """Regions cut on a grid of nine, so that components touch along seams: each is feathered on its own."""
    r = regions.route(mask(spark, sf))
    final = r["synth"].where("synth").select("frame_id", "y", "x", F.expr("cast((y div 9) * 1000 + x div 9 AS int)").alias("final"))
    return composite.feather(final, regions.frame_sizes(r["synth"])).select("y", "x", "final", "distance")


@query("batch_fill", sql("SELECT y, x, " + ", ".join(f"m8_{c}::INT AS g8_{c}" for c in "rgb") + " FROM final JOIN fills USING (final)", "final", "fills"))
def _(spark, sf):
    """The batch hook with the stand-in fill, and its archive of crops unpacked again."""
    import numpy as np

    c = _composite(spark, sf)[1]
    rows = composite.crop_rows(c["crop"], c["ranges"])
    made = composite.batch_filled(rows, lambda crops: [composite.mean_fill(rgb, own) for rgb, own in crops])
    box = c["boxes"].select("frame_id", "final", "cy0", "cx0")

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                y, x = np.nonzero(np.frombuffer(r.own, np.uint8).reshape(r.height, r.width))
                m = np.frombuffer(r.made8, np.uint8).reshape(r.height, r.width, 3)[y, x].astype(np.int32)
                yield pd.DataFrame({"y": (y + r.cy0).astype(np.int32), "x": (x + r.cx0).astype(np.int32), "g8_r": m[:, 0], "g8_g": m[:, 1], "g8_b": m[:, 2]})

    return made.join(box, ["frame_id", "final"]).mapInPandas(unpack, "y int, x int, g8_r int, g8_g int, g8_b int")


# integrity
@query("source_manifest", "SELECT count(*) AS n_files, sha256(string_agg(doc_id || ':' || sha256(text) || chr(10), '' ORDER BY doc_id::VARCHAR)) AS sha256 FROM documents")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return frames.source_manifest(d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))


@query("row_digest_tree", sql("SELECT sha256(string_agg(d, chr(10) ORDER BY y)) AS sha256 FROM (SELECT y, sha256(string_agg(r || ',' || g || ',' || b, ';' ORDER BY x)) AS d FROM px GROUP BY y)", "px"))
def _(spark, sf):
    return frames.tree_hash(px(spark, sf)).select("sha256")


@query("frame_content_hash", sql("SELECT 'main' AS frame_id, sha256(unhex(string_agg(printf('%02x%02x', r & 255, r >> 8) || printf('%02x%02x', g & 255, g >> 8) || printf('%02x%02x', b & 255, b >> 8) || printf('%02x%02x', ir & 255, ir >> 8), '' ORDER BY y, x))) AS sha256 FROM px", "px"))
def _(spark, sf):
    return frames.content_hash(px(spark, sf), frames.SAMPLES)


@query("result_parity", sql("SELECT count(*) AS pixels, sum((y % 7 = 0)::INT)::BIGINT AS differing FROM px", "px"))
def _(spark, sf):
    a = px(spark, sf)
    b = a.withColumn("r", F.col("r") + (F.col("y") % 7 == 0).cast("int")).select("frame_id", "y", "x", F.col("r").alias("r2"))
    both = a.select("frame_id", "y", "x", "r").join(b, ["frame_id", "y", "x"], "full")
    return both.agg(F.count("*").alias("pixels"), F.sum((~F.col("r").eqNullSafe(F.col("r2"))).cast("long")).alias("differing"))


@query("artefact_measure", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'png' WHEN doc_id % 5 = 1 THEN 'npy' ELSE 'opaque' END AS kind, strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 8 WHEN doc_id % 5 = 1 THEN 6 ELSE 0 END AS n_bytes, sha256(CASE WHEN doc_id % 5 = 0 THEN from_hex('89504E470D0A1A0A') WHEN doc_id % 5 = 1 THEN from_hex('934E554D5059') ELSE ''::BLOB END || encode(text)) AS sha256 FROM documents")
def _(spark, sf):
    """Texts as files, two fifths of them with the first bytes of an image or an array."""
    head = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("934E554D5059"))).otherwise(F.lit(b""))
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.length("content").cast("long").alias("length"), "content")
    return integrity.measured(files).select(F.col("path").cast("long").alias("doc_id"), "kind", "n_bytes", "sha256")


@query("artefact_roles_once", "SELECT coalesce(c_custkey, o_custkey) AS role, coalesce(n, 0) AS n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_custkey IS NULL OR n IS NULL OR n <> 1")
def _(spark, sf):
    roles = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("role"))
    return integrity.roles_once(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("role")), roles)


@query("mask_png", sql("SELECT y, x, mask FROM mask", "mask"))
def _(spark, sf):
    """The mask as images, and these read again."""
    return integrity.mask_pixels(integrity.mask_images(mask(spark, sf))).select("y", "x", "mask")


@query("stage_record_decode", "SELECT vec_id, embedding[1]::DOUBLE AS p1, embedding[2]::DOUBLE AS p2, embedding[3]::DOUBLE AS p3, embedding[4]::DOUBLE AS p4 FROM embeddings")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", *[F.element_at("embedding", i).alias(f"p{i}") for i in range(1, 5)])
    return integrity.decode_records(integrity.encode_records(e).select("vec_id", "record")).select("vec_id", *dd("p1", "p2", "p3", "p4"))


def _planes(spark, sf):
    return scored(spark, sf).select("frame_id", "y", "x", "score", "aux", X.at_floor(F.col("score")).alias("at_floor"))


def _bound(spark, sf) -> dict:
    return integrity.binding(frames.content_hash(px(spark, sf), frames.SAMPLES).first()["sha256"], None, "banded", {"limit": LIMIT})


@query("cache_round_trip", sql(f"SELECT y, x, {ds('score', 'aux')}, score = {FLOOR} AS at_floor FROM scored", "scored"))
def _(spark, sf):
    """Planes from a cache that was staged, verified and published, and verified again when read."""
    at, bound = frames.shared_folder(spark, "cache"), _bound(spark, sf)
    anchor = integrity.save_cache(_planes(spark, sf), at, bound)
    return integrity.load_cache(spark, at, bound, anchor).select("y", "x", *dd("score", "aux"), "at_floor")


@query("cache_tamper", _caps_sql("tampered", [("nothing", False), ("anchor", True), ("binding", True), ("place taken", True), ("sample", True), ("row missing", True), ("at_floor", True)]))
def _(spark, sf):
    at, bound = frames.shared_folder(spark, "cache"), _bound(spark, sf)
    planes = _planes(spark, sf)
    anchor = integrity.save_cache(planes, at, bound)
    load = lambda path=at, bound=bound, anchor=anchor: _refused(lambda: integrity.load_cache(spark, path, bound, anchor))
    rows = [("nothing", load()), ("anchor", load(anchor="0" * 64)), ("binding", load(bound=bound | {"backend": "expr"}))]
    rows.append(("place taken", _refused(lambda: integrity.save_cache(planes, at, bound), FileExistsError)))
    for name, changed in (("sample", planes.withColumn("aux", F.when((F.col("y") == 3) & (F.col("x") == 5), F.col("aux") + 1).otherwise(F.col("aux")))), ("row missing", planes.where("y <> 4"))):
        other = frames.shared_folder(spark, "cache")
        spark.read.parquet(f"{at}/frames").write.parquet(f"{other}/frames")
        integrity.write_bytes(spark, f"{other}/manifest.json", integrity.read_bytes(spark, f"{at}/manifest.json"))
        changed.write.parquet(f"{other}/planes")
        rows.append((name, load(other)))
    wrong = planes.withColumn("at_floor", F.col("at_floor") != (F.col("y") == 3))
    rows.append(("at_floor", _refused(lambda: integrity.save_cache(wrong, frames.shared_folder(spark, "cache"), bound))))
    return spark.createDataFrame(rows, "tampered string, refused boolean")


def _receipt(spark, sf):
    at, bound = frames.shared_folder(spark, "cache"), _bound(spark, sf)
    anchor = integrity.save_cache(_planes(spark, sf), at, bound)
    planes = integrity.load_cache(spark, at, bound, anchor)
    source = px(spark, sf).select("frame_id", "y", "x", "r", "g", "b")
    r = regions.route(planes.select("frame_id", "y", "x", F.col("at_floor").alias("mask")), LIMIT)
    image = frames.cut(composite.composite(source, r["synth"], r["final"], census=r["census"])["image"])
    sha = {"source": frames.content_hash(source).first()["sha256"], "composite": frames.content_hash(image).first()["sha256"], "cache_manifest": anchor}
    png = integrity.mask_images(r["synth"].select("frame_id", "y", "x", F.col("synth").alias("mask"))).select(F.sha2("png", 256)).first()[0]
    artefacts = [{"role": k, "sha256": v, "n_bytes": 1} for k, v in (sha | {"mask": png}).items()]
    receipt = receipts.build("main", source, r, image, anchor, artefacts, LIMIT, receipts.provenance("events", "made up", "a test frame"))
    return receipt, source, planes, image, anchor


@query("receipt_document", sql(_CENSUS, "synth", "disposed"))
def _(spark, sf):
    """The counts of a receipt, read from its canonical bytes."""
    import json

    c = json.loads(_receipt(spark, sf)[0])["census"]
    return spark.createDataFrame([tuple(c[n] for n in receipts.COUNTS)], ", ".join(f"{n} bigint" for n in receipts.COUNTS))


_CHECKS = ("canonical", "semantics", "cache_manifest", "source", "routing", "composite", "composite_replay", "outside_mask")


@query("receipt_replay", "SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{c}', {str(not (case == 'image' and c in ('composite', 'composite_replay', 'outside_mask') or case == 'anchor' and c == 'cache_manifest')).lower()})" for case in ("as it is", "image", "anchor") for c in _CHECKS) + """) t("case", "check", ok)""")
def _(spark, sf):
    """A receipt replayed on what it was made of, on an image with one changed sample outside the mask, and with another cache."""
    receipt, source, planes, image, anchor = _receipt(spark, sf)
    other = image.withColumn("r", F.when((F.col("y") == 0) & (F.col("x") == 0), F.col("r") + 1).otherwise(F.col("r")))
    cases = {"as it is": (image, anchor), "image": (other, anchor), "anchor": (image, "0" * 64)}
    parts = [receipts.replay(spark, receipt, source, planes, i, a).select(F.lit(name).alias("case"), "check", "ok") for name, (i, a) in cases.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("progress_metrics", sql("SELECT count(*) AS completed, sum(eligible::INT)::BIGINT AS attempted FROM eligible", "eligible"))
def _(spark, sf):
    """Counts that were observed while a table was written and published."""
    n = {"completed": F.count("*"), "attempted": F.sum(F.col("eligible").cast("long"))}
    got = integrity.run_observed(decided(spark, sf).select("frame_id", "y", "x", "eligible"), frames.shared_folder(spark, "observed"), n)
    return spark.createDataFrame([(got["completed"], got["attempted"])], "completed bigint, attempted bigint")


@query("ordered_row_stream", sql(f"SELECT y, count(*) FILTER (ir <= {dbl(P.IR_THRESHOLD)}) AS n_low, sum(ir)::BIGINT AS sum_ir FROM px GROUP BY y", "px"))
def _(spark, sf):
    """Row blocks go through the stateful stream, and what it gives comes back as a table."""
    from dustline.streaming import rows as S

    at = frames.shared_folder(spark, "stream")
    b = frames.split_blocks(px(spark, sf), 8)
    last = F.col("start_row") == F.max("start_row").over(Window.partitionBy("frame_id"))
    get = lambda c: F.transform("samples", lambda s: s[c]).alias(c)
    b.select("frame_id", "start_row", F.col("valid_rows").cast("int"), "width", last.alias("last"), get("ir"), get("r")).repartition(4).write.parquet(f"{at}/in")
    q = S.ordered_rows(S.blocks(spark, f"{at}/in"), P.IR_THRESHOLD).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(S.ROWS).parquet(f"{at}/out").select("y", "n_low", "sum_ir")
