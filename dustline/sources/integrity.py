"""What keeps results honest: measured artefacts, mask images, records, plane caches that are verified when read, publishing, progress.

A cache is a folder with Parquet planes, a table of frame digests and a canonical manifest. It is staged beside its place and renamed
there in one step that never replaces anything, so a reader sees all of it or nothing.
"""

from __future__ import annotations

import hashlib
import struct
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustline import profile as P
from dustline.sources.frames import canonical_json, read_manifest

MANIFEST_KEYS = {"binding", "frames_sha256", "n_frames", "planes", "version"}
#: Largest artefact that is measured; a longer one is refused before it is read.
MAX_BYTES = 1 << 30


# files of the shared store
def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file; an existing one is an error."""
    out = _fs(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str, most: int = 1 << 20) -> bytes:
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} isn't one file of at most {most} bytes")
    return bytes(rows[0][0])


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Renames a staged folder to its place in one step; a place that is taken is an error, and the staged folder goes."""
    fs = _fs(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        if fs.exists(_path(spark, path)):
            raise FileExistsError(path)
        context.rename(fs.makeQualified(_path(spark, staged)), fs.makeQualified(_path(spark, path)), never)
    finally:
        fs.delete(_path(spark, staged), True)


# artefacts
def measured(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """path, kind (npy, png or opaque), n_bytes and sha256 of files (path, length, content), by one read of each; the digest is taken before anything is decoded."""
    content = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("an artefact is too long: "), F.col("path"))).cast("binary")).otherwise(F.col("content"))
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("934E554D5059"), "npy").when(head == "89504E470D0A1A0A", "png").otherwise("opaque")
    return files.select("path", kind.alias("kind"), F.length("content").cast("long").alias("n_bytes"), F.sha2(content, 256).alias("sha256"))


def roles_once(artefacts: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, n) of roles that artefacts don't name exactly once, and of roles that aren't known (n of those is how often they occur)."""
    n = artefacts.groupBy("role").agg(F.count("*").alias("n"))
    both = roles.select("role", F.lit(True).alias("known")).join(n, "role", "full")
    return both.where("known IS NULL OR n IS NULL OR n <> 1").select("role", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def mask_images(mask: DataFrame) -> DataFrame:
    """(frame_id, png): 8-bit grey images, 255 where the mask is set. Rows are packed where they are; an image is made of packed rows, one frame a task."""
    line = F.aggregate(F.array_sort(F.collect_list(F.struct("x", "mask"))), F.lit(""), lambda s, v: F.concat(s, F.when(v["mask"], "FF").otherwise("00")))
    rows = mask.groupBy("frame_id", "y").agg(F.unhex(line).alias("line"))
    image = rows.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda s: s["line"]).alias("lines"))

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for lines in batch.column("lines").to_pylist():
                if len({len(x) for x in lines}) != 1:
                    raise ValueError("a mask's rows differ in width")
                head = struct.pack(">IIBBBBB", len(lines[0]), len(lines), 8, 0, 0, 0, 0)
                out.append(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 6)) + _chunk(b"IEND", b""))
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), pa.array(out, pa.binary())], names=["frame_id", "png"])

    return image.mapInArrow(make, "frame_id string, png binary")


def read_mask(png: bytes) -> np.ndarray:
    """The mask of an image that mask_images() made; any other form is an error."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            w, h, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("masks are 8-bit grey")
            size = h, w
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[0], size[1] + 1)
    if rows[:, 0].any() or not np.isin(rows[:, 1:], (0, 255)).all():
        raise ValueError("masks hold 0 and 255 in unfiltered rows")
    return rows[:, 1:] == 255


def mask_pixels(images: DataFrame) -> DataFrame:
    """(frame_id, y, x, mask) of images."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, png in zip(batch.column("frame_id").to_pylist(), batch.column("png").to_pylist()):
                m = read_mask(png)
                y, x = np.indices(m.shape, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m.size), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(m.ravel())], names=["frame_id", "y", "x", "mask"])

    return images.mapInArrow(read, "frame_id string, y int, x int, mask boolean")


# Places of the four parameters in a 64-byte stage record.
RECORD_BYTES, RECORD_AT = 64, {"p2": 0x04, "p1": 0x08, "p3": 0x28, "p4": 0x2C}


def encode_records(df: DataFrame) -> DataFrame:
    """Adds record: 64 bytes with p1 to p4 as little-endian single precision at their places, zeros elsewhere."""

    @F.pandas_udf("binary")
    def pack(p1, p2, p3, p4):
        import pandas as pd

        out = np.zeros((len(p1), RECORD_BYTES // 4), "<f4")
        for name, col in zip(("p1", "p2", "p3", "p4"), (p1, p2, p3, p4)):
            out[:, RECORD_AT[name] // 4] = col
        return pd.Series([row.tobytes() for row in out])

    return df.withColumn("record", pack("p1", "p2", "p3", "p4"))


def decode_records(df: DataFrame) -> DataFrame:
    """Adds p1, p2, p3, p4 and record_sha256; a record of another length is an error."""

    @F.pandas_udf("p1 float, p2 float, p3 float, p4 float")
    def take(record):
        import pandas as pd

        if any(len(r) != RECORD_BYTES for r in record):
            raise ValueError(f"records have {RECORD_BYTES} bytes")
        a = np.frombuffer(b"".join(map(bytes, record)), "<f4").reshape(-1, RECORD_BYTES // 4)
        return pd.DataFrame({n: a[:, RECORD_AT[n] // 4] for n in ("p1", "p2", "p3", "p4")})

    names = [c for c in df.columns if c not in ("p1", "p2", "p3", "p4", "record_sha256")]
    return df.withColumn("__p", take("record")).select(*names, "__p.*", F.sha2("record", 256).alias("record_sha256"))


# caches
def frame_digests(planes: DataFrame) -> DataFrame:
    """(frame_id, h, w, sha256): a digest of row digests, so that no task holds a frame."""
    cols = sorted(c for c in planes.columns if c not in ("frame_id", "y", "x"))
    line = F.to_json(F.array_sort(F.collect_list(F.struct("x", *cols))))
    rows = planes.groupBy("frame_id", "y").agg(F.sha2(line, 256).alias("row"), F.count("*").alias("w"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row", "w"))), lambda s: F.concat_ws(":", s["y"].cast("string"), s["row"], s["w"].cast("string"))), "\n")
    return rows.groupBy("frame_id").agg(F.count("*").alias("h"), F.max("w").alias("w"), F.sha2(lines, 256).alias("sha256"))


def _all_frames(digests: DataFrame) -> tuple[int, str]:
    """How many frames, and one digest over all, by 4,096 buckets: neither a task nor the driver holds more than a bucket or their digests."""
    line = F.concat_ws(":", "frame_id", F.col("h").cast("string"), F.col("w").cast("string"), "sha256")
    parts = digests.groupBy((F.crc32(F.col("frame_id").cast("binary")) % 4096).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("s")).orderBy("b").collect()
    return sum(r["n"] for r in parts), hashlib.sha256("\n".join(f"{r['b']}:{r['s']}" for r in parts).encode()).hexdigest()


def inconsistent(planes: DataFrame) -> DataFrame:
    """Pixels whose at_floor isn't what their score says."""
    return planes.where(~F.col("at_floor").eqNullSafe(F.col("score") == F.lit(P.SCORE_FLOOR).cast("float")))


def binding(source_sha256: str, prepass_sha256: str | None, backend: str, options: dict) -> dict:
    """What a cache belongs to. Two bindings are compared as a whole; nothing in them is optional but a missing prepass."""
    return {"backend": backend, "options": dict(sorted(options.items())), "prepass_sha256": prepass_sha256, "profile": "ls5000-normal-8-4000", "source_sha256": source_sha256}


def save_cache(planes: DataFrame, path: str, bound: dict) -> str:
    """Writes planes (frame_id, y, x, score, at_floor, ...) as a cache and returns the manifest's digest, after what was written has been read and verified."""
    spark, staged = planes.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    planes.write.parquet(f"{staged}/planes")
    written = spark.read.parquet(f"{staged}/planes")
    frame_digests(written).write.parquet(f"{staged}/frames")
    n, digest = _all_frames(spark.read.parquet(f"{staged}/frames"))
    manifest = canonical_json({"binding": bound, "frames_sha256": digest, "n_frames": n, "planes": sorted(written.columns), "version": 1})
    write_bytes(spark, f"{staged}/manifest.json", manifest)
    anchor = hashlib.sha256(manifest).hexdigest()
    load_cache(spark, staged, bound, anchor)
    publish(spark, staged, path)
    return anchor


def load_cache(spark: SparkSession, path: str, bound: dict | None = None, anchor: str | None = None) -> DataFrame:
    """A cache's planes, once everything in it has been verified: the manifest's digest and binding, every frame's digest, and that at_floor fits the score."""
    text = read_bytes(spark, f"{path}/manifest.json")
    if anchor is not None and hashlib.sha256(text).hexdigest() != anchor:
        raise ValueError("the cache's manifest isn't the expected one")
    manifest = read_manifest(text.decode(), MANIFEST_KEYS)
    if canonical_json(manifest) != text or manifest["version"] != 1:
        raise ValueError("the cache's manifest isn't in canonical form")
    if bound is not None and manifest["binding"] != bound:
        raise ValueError("the cache belongs to something else")
    planes, held = spark.read.parquet(f"{path}/planes"), spark.read.parquet(f"{path}/frames")
    if sorted(planes.columns) != manifest["planes"] or _all_frames(held) != (manifest["n_frames"], manifest["frames_sha256"]):
        raise ValueError("the cache's frames aren't those of its manifest")
    now = frame_digests(planes).select("frame_id", F.col("sha256").alias("now"))
    if held.join(now, "frame_id", "full").where("NOT (sha256 <=> now)").limit(1).count():
        raise ValueError("a cached frame isn't what its digest says")
    if inconsistent(planes).limit(1).count():
        raise ValueError("a cached mask isn't that of its score")
    return planes


# progress
def run_observed(df: DataFrame, path: str, metrics: dict, told: Callable[[int, int], None] | None = None, cancelled: threading.Event | None = None, every: float = 0.2) -> dict:
    """Writes df to path and returns the metrics of what was written; told(completed, total) hears of tasks meanwhile.

    If cancelled is set, the jobs are stopped, what was staged goes and path stays untouched.
    """
    from pyspark.sql import Observation

    spark, seen, tag = df.sparkSession, Observation(), f"dustline-{uuid.uuid4().hex}"
    staged, failed = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", []

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(staged)
        except Exception as e:  # told to the caller below
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    tracker = spark.sparkContext.statusTracker()
    while thread.is_alive():
        thread.join(every)
        if cancelled is not None and cancelled.is_set():
            spark.sparkContext.cancelJobsWithTag(tag)
        if told:
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            told(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))
    if failed or (cancelled is not None and cancelled.is_set()):
        _fs(spark, staged).delete(_path(spark, staged), True)
        raise failed[0] if failed and not (cancelled is not None and cancelled.is_set()) else InterruptedError("cancelled")
    publish(spark, staged, path)
    return seen.get

