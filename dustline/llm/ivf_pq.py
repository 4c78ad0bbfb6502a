"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals, asymmetric distances, exact reranking.

fit() learns centroids and codebooks on a bounded sample (SAMPLE rows by a hash of vec_id) and chooses, on that sample, how
many lists to probe and how many candidates to rerank: the fewest that keep `recall` of the sample's true neighbours. index() codes every row.
search() sends each query to its lists with a reach: as the sample's rows are rows of the index, no candidate beyond the last place that
the sample alone fills can come into the query's best, so blocks give back only what lies within it. A list's codes are scanned in blocks by a
table of distances; each block gives a query's best as one packed row; these are merged for each query and reranked by distances of the
original vectors in double precision. audit() measures recall against brute force.

Rows: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite components take no part, as query or
candidate; rows without id neither. Equal distances go to the smaller id. With fewer candidates than asked, all are returned. Repeated rows (an id twice) count once, with the
smaller vector. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline.llm.common import table
from dustline.llm.vectors import matrix, usable

SAMPLE, LISTS, PARTS, ROUNDS = 16_384, 1024, 16, 8
#: Rows of a list, and queries, that one task scans at a time.
BLOCK, QUERY_BLOCK = 16_384, 1024


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = squared(x, c).argmin(1)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.bincount(at, x[:, d], k) / np.maximum(n, 1)
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class Quantizer:
    """Coarse centroids [list, d] and codebooks [part, code, d of the part]; probes and depth as chosen by fit()."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, neighbours: int, recall: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        self.dim = x.shape[1]
        self.coarse = kmeans(x, lists, rng)
        own = squared(x, self.coarse).argmin(1)
        rest = x - self.coarse[own]
        edges = np.linspace(0, self.dim, min(parts, self.dim) + 1).astype(int)
        self.edges = list(zip(edges[:-1], edges[1:]))
        self.books = [kmeans(rest[:, a:b], 256, rng) for a, b in self.edges]
        codes = self.encode(x)[1]
        self.held = [codes[own == lst] for lst in range(len(self.coarse))]
        self._tune(x, own, codes, neighbours, recall, rng)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float32)
        own = squared(x, self.coarse).argmin(1)
        rest = x - self.coarse[own]
        codes = np.empty((len(x), len(self.edges)), np.uint8)
        for i, (a, b) in enumerate(self.edges):
            codes[:, i] = squared(rest[:, a:b], self.books[i]).argmin(1)
        return own, codes

    def nearest_lists(self, q: np.ndarray, n: int) -> np.ndarray:
        d = squared(q.astype(np.float32), self.coarse)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def scan(self, q: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances [query, row] of one list's rows."""
        rest = q.astype(np.float32) - self.coarse[lst]
        out = np.zeros((len(q), len(codes)), np.float32)
        for i, (a, b) in enumerate(self.edges):
            out += squared(rest[:, a:b], self.books[i])[:, codes[:, i]]
        return out

    def reach(self, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """For each query the distance by code within which `depth` rows besides its own lie, in its lists, of the sample alone; infinite if fewer do. A little is added for rounding."""
        out = np.full(len(q), np.inf, np.float32)
        at = np.cumsum([0] + [len(c) for c in self.held])
        if at[-1] <= self.depth:
            return out
        for s in range(0, len(q), 128):
            far = np.full((len(q[s : s + 128]), at[-1]), np.inf, np.float32)
            for lst in np.unique(lists[s : s + 128]):
                who = np.flatnonzero((lists[s : s + 128] == lst).any(1))
                far[who, at[lst] : at[lst + 1]] = self.scan(q[s : s + 128][who], lst, self.held[lst])
            out[s : s + 128] = np.partition(far, self.depth, axis=1)[:, self.depth]
        return out * np.float32(1.0001) + np.float32(1e-6)

    def _tune(self, x, own, codes, neighbours, recall, rng) -> None:
        """Probes: as many lists as hold `recall` of a sample's true neighbours; depth: the rank by code that as many of them reach, doubled and scaled by nothing else, as more rows move ranks and true neighbours alike."""
        q = rng.choice(len(x), min(256, len(x)), replace=False)
        d = squared(x[q], x)
        d[np.arange(len(q)), q] = np.inf
        k = min(neighbours, len(x) - 1)
        self.probes, self.depth = len(self.coarse), 16 * neighbours
        if k < 1:
            return
        true = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort(squared(x[q], self.coarse), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
        want = 1 - (1 - recall) / 2
        self.probes = int(np.quantile(np.take_along_axis(place, own[true], 1), want)) + 1
        far = np.empty((len(q), len(x)), np.float32)
        for lst in range(len(self.coarse)):
            rows = np.flatnonzero(own == lst)
            if len(rows):
                far[:, rows] = self.scan(x[q], lst, codes[rows])
        far[np.arange(len(q)), q] = np.inf
        reach = np.sort(far, axis=1)
        rank = np.array([np.searchsorted(reach[i], far[i, true[i]]) for i in range(len(q))])
        self.depth = max(4 * neighbours, 2 * int(np.quantile(rank, want)) + neighbours)


def clean(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, each id once."""
    rows = df.where(usable(df, vector) & F.col(key).isNotNull())
    return rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))


def fit(rows: DataFrame, neighbours: int = 10, recall: float = 0.97, sample: int = SAMPLE, lists: int | None = None, parts: int = PARTS) -> Quantizer | None:
    """Learns on at most `sample` rows; lists defaults to the root of the number of rows, LISTS at most."""
    n = rows.count()
    got = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).toPandas()
    if not len(got):
        return None
    lengths = got["v"].map(len)
    x = np.array(got["v"][lengths == lengths.mode()[0]].tolist(), dtype=np.float64)
    lists = lists or int(min(LISTS, max(1, round(n**0.5 / 2))))
    return Quantizer(x, min(lists, max(1, len(x) // 16)), parts, neighbours, recall)


def index(rows: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(id, list, code) of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = sent.value.encode(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    return rows.where(F.size("v") == quantizer.dim).mapInArrow(run, "id bigint, list int, code binary")


def search(rows: DataFrame, queries: DataFrame, quantizer: Quantizer | None, neighbours: int = 10, indexed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of rows (id, v) for queries (id, v), a query's own id excepted."""
    spark = rows.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if quantizer is None:
        return spark.createDataFrame([], empty)
    sent, depth = spark.sparkContext.broadcast(quantizer), quantizer.depth
    codes = indexed if indexed is not None else table(index(rows, quantizer))
    queries = queries.where(F.size("v") == quantizer.dim)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("v"))
                lists = sent.value.nearest_lists(q, sent.value.probes)
                reach = sent.value.reach(q, lists)
                for s in range(0, len(q), QUERY_BLOCK):
                    part = lists[s : s + QUERY_BLOCK]
                    i = s + np.repeat(np.arange(len(part)), part.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), batch.column("v").take(pa.array(i)), pa.array(part.ravel().astype(np.int32)), pa.array(reach[i])], names=["id", "v", "list", "reach"])

    probed = queries.select("id", "v").mapInArrow(probe, "id bigint, v array<double>, list int, reach float")
    # blocks of a list's rows meet blocks of its queries; counts by list have `lists` rows at most
    blocks = codes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rb"))
    qblocks = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qb"))
    dealt = blocks.join(qblocks, "list")
    left = codes.join(F.broadcast(dealt), "list").withColumn("r", F.pmod(F.xxhash64("id"), "rb").cast("int")).withColumn("q", F.explode(F.expr("sequence(0, qb - 1)")))
    right = probed.join(F.broadcast(dealt), "list").withColumn("q", F.pmod(F.xxhash64("id"), "qb").cast("int")).withColumn("r", F.explode(F.expr("sequence(0, rb - 1)")))

    def scan(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"id": [], "d": [], "near": []}
        if a.num_rows and b.num_rows:
            a = a.sort_by("id")  # so that of equal distances the smaller ids are kept
            c = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(a.num_rows, -1)
            ids, q, reach = a.column("id").to_numpy(), matrix(b.column("v")), b.column("reach").to_numpy()
            own = b.column("id").to_pylist()
            for s in range(0, len(q), 128):
                for row, to, name in zip(sent.value.scan(q[s : s + 128], key[0].as_py(), c), reach[s : s + 128], own[s : s + 128]):
                    at = np.flatnonzero((row <= to) & (ids != name))
                    at = at[np.argsort(row[at], kind="stable")[:depth]]
                    if len(at):
                        out["id"].append(name)
                        out["d"].append(row[at].tobytes())
                        out["near"].append(ids[at].astype(np.int64).tobytes())
        return pa.table(out, pa.schema([("id", pa.int64()), ("d", pa.binary()), ("near", pa.binary())]))

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d = np.frombuffer(b"".join(t.column("d").to_pylist()), np.float32)
        ids = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int64)
        ids = ids[np.lexsort((ids, d))[:depth]]
        return pa.table({"query_id": pa.array(np.full(len(ids), key[0].as_py(), np.int64)), "id": pa.array(ids)})

    near = left.select("list", "r", "q", "id", "code").groupBy("list", "r", "q").cogroup(right.select("list", "r", "q", "id", "v", "reach").groupBy("list", "r", "q")).applyInArrow(scan, "id bigint, d binary, near binary")
    # a query's packed rows are at most its lists' blocks, each of at most `depth` entries
    best = near.groupBy("id").applyInArrow(merge, "query_id bigint, id bigint")
    by = Window.partitionBy("query_id")
    exact = best.join(rows.select("id", F.col("v").alias("b")), "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id")
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    exact = exact.select("query_id", F.col("id").alias("vec_id"), gap.alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(by.orderBy("score", "vec_id"))).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, queries: DataFrame, neighbours: int = 10) -> DataFrame:
    """The true neighbours of a bounded set of queries (they are broadcast in full, so it must be small), for audits."""
    got = queries.toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((got["id"].to_numpy(), np.array(got["v"].tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for batch in batches:
            if batch.num_rows:
                x, own = matrix(batch.column("v")), np.asarray(batch.column("id"))
                d = squared(q, x)
                d[ids[:, None] == own[None]] = np.inf
                k = min(neighbours, d.shape[1])
                at = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(own[at].ravel()), pa.array(np.take_along_axis(d, at, 1).ravel())], names=["query_id", "vec_id", "d"])

    near = rows.mapInArrow(run, "query_id bigint, vec_id bigint, d double").where("isnotnull(d) AND d < double('infinity')")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= neighbours)


def audit(found: DataFrame, true: DataFrame) -> float:
    """The share of true neighbours that were found."""
    n = true.count()
    return true.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    quantizer = fit(rows)
    return search(rows, rows.where("id % 100 = 0"), quantizer)
