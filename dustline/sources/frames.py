"""Frames as tables (frame_id, y, x, r, g, b, ir), and what carries them in and out.

A frame is one capture, bounded by the sensor; a table holds any number of frames, which are the unit of distribution.
"""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXELS = T.StructType([T.StructField("frame_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b", "ir")]])
SAMPLES = ("r", "g", "b", "ir")


def checked(px: DataFrame) -> DataFrame:
    """Refuses columns of other names or types; nothing is coerced."""
    want = {f.name: f.dataType for f in PIXELS}
    for name, kind in want.items():
        if name not in px.columns or px.schema[name].dataType != kind:
            raise TypeError(f"pixel tables need {name} {kind.simpleString()}")
    return px.select(*want)


def events_frame(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """One frame whose samples are integer functions of place and of the events' values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    e = e.select(
        F.lit("main").alias("frame_id"),
        F.expr(f"cast(event_id div {width} AS int)").alias("y"),
        F.expr(f"cast(event_id % {width} AS int)").alias("x"),
        F.floor(F.col("value") * 100 + 0.5).alias("c"),
    )
    e = e.withColumn("ym", F.expr("y % 50"))
    ir = (
        F.when(F.expr("ym = 9 AND x >= 60 AND x < 85"), F.expr("43000 + c % 4000"))
        .when(F.expr("ym >= 14 AND ym < 17 AND x >= 40 AND x < 43"), 900)
        .when(F.expr("ym >= 2 AND ym < 8 AND x >= 96"), 700)
        .when(F.expr("ym >= 5 AND ym < 8 AND x >= 10 AND x < 13"), 900)
        .when(F.expr("ym >= 20 AND ym < 46 AND x >= 30 AND x < 56"), F.expr("500 + c % 300"))
        .otherwise(F.expr("50000 + (31 * y + 29 * x) % 600 + c % 1500"))
    )
    return e.select(
        "frame_id",
        "y",
        "x",
        F.expr("cast(30000 + (53 * y + 97 * x) % 3000 + c % 400 AS int)").alias("r"),
        F.expr("cast(32000 + (67 * y + 71 * x) % 3000 + c % 400 AS int)").alias("g"),
        F.expr("cast(34000 + (89 * y + 43 * x) % 3000 + c % 400 AS int)").alias("b"),
        ir.cast("int").alias("ir"),
    )


def prepass_frame(px: DataFrame) -> DataFrame:
    """Every second pixel each way, re-indexed."""
    return px.where("y % 2 = 0 AND x % 2 = 0").withColumns({"y": F.expr("cast(y div 2 AS int)"), "x": F.expr("cast(x div 2 AS int)")})


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """uint16 [H, W, 4] arrays in .npy files, one frame each, named by their path; other dtypes, shapes and pickles are errors."""

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.dtype != np.uint16 or a.ndim != 3 or a.shape[2] != 4 or not a.flags.c_contiguous:
                    raise TypeError(f"{name}: frames must be uint16 H x W x 4 in C order")
                for y in range(0, a.shape[0], 256):
                    part = a[y : y + 256].astype(np.int32)
                    h, w = part.shape[:2]
                    cols = [pa.array([name] * (h * w)), pa.array(np.repeat(np.arange(y, y + h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h))]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(part[..., c].ravel()) for c in range(4)], names=[f.name for f in PIXELS])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, PIXELS)


def npy_header(files: DataFrame) -> DataFrame:
    """path, version, fortran_order, dtype, shape and whether the length is what the header promises, before any array is made."""

    @F.pandas_udf("version string, fortran boolean, dtype string, shape string, whole boolean")
    def head(content, length):
        import pandas as pd

        rows = []
        for c, n in zip(content, length):
            f = io.BytesIO(bytes(c))
            try:
                v = np.lib.format.read_magic(f)
                shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if v == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                rows.append((f"{v[0]}.{v[1]}", fortran, dtype.str, str(shape), f.tell() + dtype.itemsize * int(np.prod(shape, dtype=object)) == n))
            except ValueError:
                rows.append((None, None, None, None, False))
        return pd.DataFrame(rows, columns=["version", "fortran", "dtype", "shape", "whole"])

    return files.withColumn("h", head("content", "length")).select("path", "h.*")


def write_frames(px: DataFrame, path: str) -> None:
    """Parquet, one folder for each frame, so a reader of one frame reads no other; refuses an existing path."""
    px.write.mode("errorifexists").partitionBy("frame_id").parquet(path)


def split_blocks(px: DataFrame, rows: int) -> DataFrame:
    """Blocks of whole rows: (frame_id, block, start_row, valid_rows, width, samples in row-major order)."""
    b = px.withColumn("block", F.expr(f"cast(y div {rows} AS int)"))
    b = b.groupBy("frame_id", "block").agg(
        F.min("y").alias("start_row"),
        (F.max("y") - F.min("y") + 1).alias("valid_rows"),
        (F.max("x") + 1).alias("width"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", *SAMPLES))), lambda s: F.struct(*[s[c].alias(c) for c in SAMPLES])).alias("samples"),
    )
    return b


def block_schedule(height: int, rows: int) -> list[int]:
    """Valid rows of each block; the last may have fewer."""
    return [min(rows, height - at) for at in range(0, height, rows)]


def block_gaps(blocks: DataFrame) -> DataFrame:
    """Each block with where it should begin: gap is 0 in an ordered, gap-free frame of one width."""
    w = Window.partitionBy("frame_id").orderBy("start_row")
    want = F.coalesce(F.lag(F.col("start_row") + F.col("valid_rows")).over(w), F.lit(0))
    same = F.coalesce(F.lag("width").over(w), F.col("width")) == F.col("width")
    return blocks.withColumns({"gap": F.col("start_row") - want, "same_width": same})


def assemble_blocks(blocks: DataFrame) -> DataFrame:
    """Pixels of blocks; frames with gaps, overlaps or changes of width raise while they are read."""
    ok = block_gaps(blocks)
    bad = (F.col("gap") != 0) | ~F.col("same_width") | (F.size("samples") != F.col("valid_rows") * F.col("width"))
    ok = ok.withColumn("samples", F.when(bad, F.raise_error(F.lit("row blocks must be ordered and gap-free"))).otherwise(F.col("samples")))
    s = ok.select("frame_id", "start_row", "width", F.posexplode("samples").alias("i", "s"))
    return s.select("frame_id", F.expr("cast(start_row + i div width AS int)").alias("y"), F.expr("cast(i % width AS int)").alias("x"), *[F.col(f"s.{c}").alias(c) for c in SAMPLES])


def content_hash(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """SHA-256 of each frame's little-endian samples in row-major order. Sorted within a frame and hashed as a stream; no frame is held whole."""
    names = list(channels)

    def run(batches):
        import pyarrow as pa

        at, digest = None, None
        for batch in batches:
            frames, cols = np.asarray(batch.column("frame_id").to_pylist(), dtype=object), np.stack([np.asarray(batch.column(c)) for c in names], axis=1).astype("<u2")
            out = []
            cuts = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(frames)] if len(frames) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if frames[s] != at:
                    if digest is not None:
                        out.append((at, digest.hexdigest()))
                    at, digest = frames[s], hashlib.sha256()
                digest.update(cols[s:e].tobytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["frame_id", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["frame_id", "sha256"])

    rows = px.select("frame_id", "y", "x", *names).repartition("frame_id").sortWithinPartitions("frame_id", "y", "x")
    return rows.mapInArrow(run, "frame_id string, sha256 string")


def tree_hash(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """A digest of row digests: distributed over rows, and so another digest than content_hash's."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", *channels))), lambda s: F.concat_ws(",", *[s[c].cast("string") for c in channels])), ";")
    rows = px.groupBy("frame_id", "y").agg(F.sha2(line, 256).alias("row_sha256"))
    return rows.groupBy("frame_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row_sha256"))), lambda s: s["row_sha256"]), "\n"), 256).alias("sha256"))


def source_manifest(files: DataFrame, last: str | None = None) -> DataFrame:
    """SHA-256 over `path:sha256` lines in the order of paths; `last`, if named, comes last."""
    each = files.select(F.coalesce(F.col("path") == F.lit(last), F.lit(False)).alias("z"), "path", F.sha2("content", 256).alias("sha"))

    def run(batches):
        import pyarrow as pa

        n, digest = 0, hashlib.sha256()
        for batch in batches:
            for path, sha in zip(batch.column("path").to_pylist(), batch.column("sha").to_pylist()):
                digest.update(f"{path}:{sha}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["n_files", "sha256"])

    # contents are hashed where they are; a digest over ordered lines needs one task, which streams them and holds none
    return each.repartition(1).sortWithinPartitions("z", "path").mapInArrow(run, "n_files bigint, sha256 string")


def canonical_json(document: dict) -> bytes:
    """Sorted keys, no spaces, no non-finite numbers, one newline."""
    return (json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()


def read_manifest(text: str, keys: set[str]) -> dict:
    """Strict JSON: no repeated keys, no non-finite numbers, exactly these keys."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a manifest key occurs twice")
        return dict(items)

    def refuse(x):
        raise ValueError(f"a manifest number isn't finite: {x}")

    got = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    if set(got) != keys:
        raise ValueError(f"manifest keys must be {sorted(keys)}")
    return got


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a session on one machine may name none and gets a local one."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="dustline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A table in the shared folder, reread: what several later steps use is computed once, and a lost executor costs a reread."""
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
