"""What several operators of this subpackage share: tables that cut lineage, words, and hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters are lowered and all white space of the word rule becomes a space, byte by byte, so UTF-8 stays intact.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine (tests) may name none and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="dustline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of an Arrow batch that goes to a Python worker: texts have kilobytes, so Spark's own 10,000 make batches of many megabytes on both sides.
BATCH_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of a session that has no bound of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def tidy() -> None:
    """Gives the memory that a worker has freed back to the system: a worker outlives its task, and Spark reuses it for the next operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow in bounded batches, by workers that keep nothing once a task has ended."""
    text_batches(df.sparkSession)

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, schema)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is run within deletes its shuffle files as soon as it is done, unless the session says otherwise. Nothing reads a table's plan again.

    A shuffle has three files for each task, of a disk block at least, so many small ones in many partitions take more room than their rows do.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, None)
    if own is None:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)


def table(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df to a Parquet table in the shared folder and reads it back: its lineage ends there, so a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/dustline-{uuid.uuid4().hex}"
    with shuffles_end(df.sparkSession):
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._dustline_path = path
    collect_garbage(df.sparkSession)
    return out


_collected = [0.0]


def trim_driver(spark: SparkSession) -> None:
    """Gives native memory that the driver's JVM has freed back to the system: compiling the code of many plans leaves over 100 MB, which the C library keeps.

    It is the JVM's own diagnostic command; a JVM or C library without it (not HotSpot, not glibc) goes on as it is.
    """
    jvm = spark._jvm
    try:
        # the server's class isn't exported, so the method is that of its interface
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def collect_garbage(spark: SparkSession, seconds: float = 3.0) -> None:
    """Shuffle files stay on executors' disks until the driver's JVM collects what refers to them; operators of many steps ask for that now and then."""
    if time.monotonic() - _collected[0] > seconds:
        spark._jvm.System.gc()
        trim_driver(spark)
        tidy()
        _collected[0] = time.monotonic()


def drop_table(df: DataFrame) -> None:
    """Deletes what table() wrote, once nothing reads it any more."""
    path = getattr(df, "_dustline_path", None)
    if not path:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the constants are those published for splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INV = U(pow(int(_P), -1, 2**64))
_Q = U(0xC2B2AE3D27D4EB4F)
_Q_INV = U(pow(int(_Q), -1, 2**64))
#: Powers that a worker keeps; longer rows of them are made when asked for, and not kept.
KEPT = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, KEPT), base, U)
            step[0] = 1
            got = np.multiply.accumulate(step)
        if n <= KEPT:
            _powers[int(base)] = got
    return got[:n]


class Words:
    """The words of a text (runs of other bytes than white space, A-Z lowered), with 64-bit hashes of any run of words.

    norm holds the words joined by single spaces; starts and ends are byte offsets of each word in it. Bytes are hashed a stretch of KEPT at a time (or one
    longer word), so a text needs its own size and a few numbers for each word.
    """

    __slots__ = ("norm", "starts", "ends", "_sums", "_other")

    def __init__(self, text: str | None):
        self.norm = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
        b = np.frombuffer(self.norm, np.uint8)
        gaps = np.flatnonzero(b == 32)
        if len(b):
            self.starts = np.concatenate(([0], gaps + 1))
            self.ends = np.concatenate((gaps, [len(b)]))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self._sums = self._other = None

    def __len__(self) -> int:
        return len(self.starts)

    def _each(self) -> np.ndarray:
        """A hash of each word: a polynomial over random 64-bit byte values, mixed."""
        out = np.empty(len(self), U)
        i = 0
        while i < len(out):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + KEPT, side="right")))
            b = np.frombuffer(self.norm, np.uint8, int(self.ends[j - 1] - base), int(base))
            sums = np.zeros(len(b) + 1, U)
            np.cumsum(_BYTE[b] * _power(_P, len(b)), out=sums[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * _power(_P_INV, len(b))[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
            i = j
        return out

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs from word first to word last, both included: a polynomial over the words' hashes, mixed."""
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self) + 1, U)
                np.cumsum(self._each() * _power(_P, len(self)), out=self._sums[1:])
            h = (self._sums[last + 1] - self._sums[first]) * _power(_P_INV, len(self))[first]
            return mix(h + (last - first + 1).astype(U) * U(0xA0761D6478BD642F))

    def checks(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """32 more bits of the same runs, by a polynomial over another base."""
        with np.errstate(over="ignore"):
            if self._other is None:
                self._other = np.zeros(len(self) + 1, U)
                np.cumsum(mix(self._each()) * _power(_Q, len(self)), out=self._other[1:])
            h = (self._other[last + 1] - self._other[first]) * _power(_Q_INV, len(self))[first]
            return (mix(h) >> U(32)).astype(np.uint32).view(np.int32)

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all runs of n words in order; of the whole sequence if it is shorter; none without words."""
        k = len(self)
        if not k:
            return np.zeros(0, U)
        first = np.arange(max(1, k - n + 1))
        return self.hashes(first, np.minimum(first + n - 1, k - 1))

    def shingles(self, n: int = 5) -> np.ndarray:
        """The set of them, sorted."""
        return np.unique(self.runs(n))


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    if not len(a) or not len(b):
        return 0, len(a) + len(b)
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return both, len(a) + len(b) - both


def pieces(batch, most: int = 4 << 20, column: str = "text"):
    """Slices of an Arrow batch whose texts together have about so many bytes, so that memory doesn't follow the batch's rows."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Edges up to which components are found by the driver, which then holds a few MB; more take rounds of joins.
FEW_EDGES = 65_536


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components) of edges between ids: component is the smallest id."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    for i, x in enumerate(up):  # what is above stands before
        up[i] = up[x]
    return ids, ids[np.array(up, np.int64)]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b), as rows (id, component) for every id that an edge names; component is the smallest id.

    Up to FEW_EDGES edges are joined by the driver, as dozens of shuffles cost more than so few rows. Others take large-star and small-star rounds:
    each sends a node's neighbours to its smallest one, so no node gathers a component and rounds grow with the logarithm of the longest path. Each round
    is a table in the shared folder.
    """
    given = table(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v"))
    if given.count() <= FEW_EDGES:
        few = given.toArrow()
        drop_table(given)
        ids, component = joined(few.column("u").to_numpy(), few.column("v").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"id": ids, "component": component}), "id bigint, component bigint")
    now = table(given.distinct())
    drop_table(given)
    before = None
    for _ in range(rounds):
        both = now.union(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = table(small.where("u <> v").distinct())
        drop_table(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
