"""Embedding near-duplicates by NN-descent.

1. Equal vectors form a class with the smallest vec_id; copies count in n_links by arithmetic, not as pairs.
2. First neighbour lists: random hyperplanes deal the vectors into cells, several times over; a cell too large for one task is
   split by a hash; vectors of a cell are compared with each other and each keeps its nearest.
3. NN-descent: each vector introduces its neighbours (by its list and by others' lists that name it) to each other; lists keep
   the best. A list whose last entry is still over the threshold is saturated and gets twice the room. Rounds end when hardly any link is new.
   Pairs under `floor` are dropped from lists: a neighbour that far away leads to no link but by chance.
   Before lists are trimmed, all pairs over the threshold that a cell or a host saw tie their vectors: of each such set of pairs a spanning
   forest is kept, which connects what they all connect, so room in lists decides no component.
   Lists that are full of links show no other group: where there are such, components are dealt into cells anew, with lists that
   leave out a vector's own component, and those neighbours are introduced too, until no components are tied any more.
4. The threshold edges that are found are the links: they make components, and n_links counts them. A list that holds `room` links may have left some out; classes of
   components with such a list are compared in blocks that only count, so that no list bounds n_links. Vectors without a saturated list in their component meet no such block.
5. audit() measures the recall of links for a bounded set of vectors against all rows. Under AIM the whole is done again with more and other deals.

Rows: vectors that are null, empty or zero or hold null or non-finite components link with nothing; so do vectors of different lengths;
rows without id are returned, linked with nothing; of equally near entries of a list the smaller id comes first; other columns aren't read; an id that occurs twice is one vector (the smaller one), returned as often as it came;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline.llm.common import components, drop_table, table
from dustline.llm.vectors import matrix, usable

LIST, MOST, CELL, BLOCK = 16, 64, 512, 1024
#: Recall that the audit asks for, and vectors that it takes.
AIM, AUDITED = 0.95, 128
#: How far single precision may be off: pairs so near the threshold are decided in double.
CLOSE = 1e-4


def classes(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(id, v, m): each distinct usable vector with its smallest id and how many ids have it; and (vec, id) membership as second result."""
    rows = df.where(usable(df, vector) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("vec")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    rows = table(rows)
    units = rows.groupBy("v").agg(F.min("vec").alias("id"), F.count("*").alias("m"))
    units = table(units.select("id", "v", "m"))
    member = rows.join(units.select("id", "v"), "v").select("vec", "id")
    return units, member


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def deals(n: int, threshold: float, missed: float = 0.002, most: int = 48) -> tuple[int, int]:
    """Planes for cells of about CELL vectors, and deals so that a pair at the threshold shares a cell with all but `missed`."""
    planes = max(0, math.ceil(math.log2(max(1, n / CELL))))
    p = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, 1 if p >= 1 else min(most, math.ceil(math.log(missed) / math.log(1 - p)))


def ties(cos: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of a block over the threshold as many as connect the same rows, and all near it that could connect more: these are decided in double precision later."""
    near = cos >= threshold + CLOSE
    np.fill_diagonal(near, False)
    part = np.arange(len(cos))
    i, j = [], []
    if near.any():
        unseen = np.ones(len(cos), bool)
        for start in np.flatnonzero(near.any(axis=1)):
            if not unseen[start]:
                continue
            unseen[start], todo = False, [start]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(near[at] & unseen)
                unseen[new] = False
                part[new] = start
                i += [at] * len(new)
                j += new.tolist()
                todo += new.tolist()
    x, y = np.nonzero(np.triu((cos >= threshold - CLOSE) & ~near, 1))
    open_ = part[x] != part[y]
    return np.concatenate((np.array(i, np.int64), x[open_])), np.concatenate((np.array(j, np.int64), y[open_]))


def first_lists(units: DataFrame, n: int, threshold: float, floor: float, room: int, seed: int = 17, group: DataFrame | None = None, more: int = 1) -> DataFrame:
    """(a, b, c, tie) directed pairs with cosine c >= floor found in cells; at most `room` for each vector and cell, and the ties of each cell.

    group (id, component, large): only pairs across components count, of which one at least is large.
    """
    planes, turns = deals(n, threshold, 0.002 / more, 48 * more)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("v").offsets)) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(lengths):  # vectors of unlike lengths don't meet
                own = batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = unit(matrix(own.column("v"))).astype(np.float32)
                f = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                for turn in range(turns):
                    plane = np.random.default_rng((seed, turn, x.shape[1])).standard_normal((x.shape[1], planes)).astype(np.float32)
                    code = ((x @ plane) > 0) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), turn, np.int32)), pa.array(code), pa.array(np.full(len(x), x.shape[1], np.int32)), own.column("id"), f], names=["turn", "code", "d", "id", "x"])

    rows = dealt = table(units.select("id", "v").mapInArrow(deal, "turn int, code bigint, d int, id bigint, x array<float>"))
    if group is not None:
        rows = rows.join(group, "id", "left").withColumns({"component": F.coalesce("component", "id"), "large": F.coalesce("large", F.lit(False))})
    else:
        rows = rows.withColumns({"component": F.col("id"), "large": F.lit(True)})
    sizes = rows.groupBy("turn", "d", "code").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("splits"))
    cells = rows.join(sizes, ["turn", "d", "code"]).withColumn("split", F.pmod(F.xxhash64("id", "turn"), "splits").cast("int"))

    def compare(cell: pa.Table) -> pa.Table:
        ids, own, large = (cell.column(k).to_numpy() for k in ("id", "component", "large"))
        x = matrix(cell.column("x"), np.float32)
        full = x @ x.T  # a cell has about 2 CELL vectors at most
        full[(own[:, None] == own) | ~(large[:, None] | large)] = -2
        i, j = ties(full, threshold)
        a, b, c, tie = [ids[i]], [ids[j]], [full[i, j]], [np.ones(len(i), bool)]
        for s in range(0, len(x), 1024):
            cos = full[s : s + 1024]
            if cos.shape[1] > room:
                at = np.argpartition(-cos, room - 1, axis=1)[:, :room]
            else:
                at = np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
            val = np.take_along_axis(cos, at, 1)
            i, j = np.nonzero(val >= floor)
            a.append(ids[s + i])
            b.append(ids[at[i, j]])
            c.append(val[i, j])
            tie.append(np.zeros(len(i), bool))
        join = lambda z, t: pa.array(np.concatenate(z).astype(t))
        return pa.table({"a": join(a, np.int64), "b": join(b, np.int64), "c": join(c, np.float32), "tie": join(tie, bool)})

    found = cells.select("turn", "d", "code", "split", "id", "x", "component", "large").groupBy("turn", "d", "code", "split").applyInArrow(compare, "a bigint, b bigint, c float, tie boolean")
    out = table(found.groupBy("a", "b").agg(F.max("c").alias("c"), F.max("tie").alias("tie")))
    drop_table(dealt)
    return out


def trimmed(pairs: DataFrame, threshold: float, room: int, most: int) -> DataFrame:
    """Lists of the best: `room` entries, or more while entries stay over the threshold (a saturated list), up to `most`."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("c").desc(), "b"))
    return pairs.withColumn("k", rank).where((F.col("k") <= room) | ((F.col("c") >= threshold) & (F.col("k") <= most))).drop("k")


def introduced(lists: DataFrame, units: DataFrame, threshold: float, floor: float, room: int, turn: int) -> DataFrame | None:
    """(a, b, c, tie): pairs that a common neighbour introduces, and which of them are ties; a table."""
    both = lists.select(F.col("a").alias("host"), F.col("b").alias("guest")).union(lists.select(F.col("b").alias("host"), F.col("a").alias("guest"))).distinct()
    # a host that very many lists name introduces a share of them, another one in each round; step 4 counts whatever stays unseen
    busy = both.groupBy("host").agg(F.count("*").alias("n"))
    both = both.join(busy, "host").where((F.xxhash64("host", "guest", F.lit(turn)) / float(2**64) + 0.5) < 4.0 * room / F.col("n")).select("host", "guest")
    n = both.select("host").distinct().count()
    if not n:
        return None
    guests = both.join(units.select(F.col("id").alias("guest"), F.col("v").cast("array<float>").alias("x")), "guest").withColumn("pack", F.pmod(F.xxhash64("host"), F.lit(max(1, n // 64))))

    def meet(pack: pa.Table) -> pa.Table:
        host, guest = pack.column("host").to_numpy(), pack.column("guest").to_numpy()
        x = unit(matrix(pack.column("x"), np.float32))
        order = np.argsort(host, kind="stable")
        edges = np.flatnonzero(np.diff(host[order], prepend=host[order[0]] - 1 if len(order) else 0))
        a, b, c, tie = [], [], [], []
        for s, e in zip(edges, [*edges[1:], len(order)]):
            at = order[s:e]
            cos = x[at] @ x[at].T
            i, j = np.nonzero(np.triu(cos >= floor, 1))
            tied = np.zeros(cos.shape, bool)
            if (cos[i, j] >= threshold - CLOSE).any():
                tied[ties(cos, threshold)] = True
            tie.append((tied | tied.T)[i, j])
            a.append(np.minimum(guest[at[i]], guest[at[j]]))
            b.append(np.maximum(guest[at[i]], guest[at[j]]))
            c.append(cos[i, j])
        join = lambda z, t: pa.array(np.concatenate(z).astype(t) if z else np.zeros(0, t))
        return pa.table({"a": join(a, np.int64), "b": join(b, np.int64), "c": join(c, np.float32), "tie": join(tie, bool)})

    half = guests.select("pack", F.size("x").alias("d"), "host", "guest", "x").groupBy("pack", "d").applyInArrow(meet, "a bigint, b bigint, c float, tie boolean")
    half = table(half.where("a <> b").groupBy("a", "b").agg(F.max("c").alias("c"), F.max("tie").alias("tie")))
    return half


def links_within(units: DataFrame, group: DataFrame, threshold: float) -> DataFrame:
    """(id, n): for each class of a component, how many ids of other classes of it lie within the threshold, in double precision."""
    rows = table(group.select("id", "component").join(units, "id"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("s"))
    packs = F.ceil(F.col("total") / BLOCK)
    total = rows.count()
    sized = rows.join(sizes, "component").withColumn("total", F.lit(total))
    small = F.col("s") <= BLOCK
    # small components share a pack; blocks of a large one meet pairwise
    sized = sized.withColumns(
        {
            "pack": F.when(small, F.pmod(F.xxhash64("component"), packs)).otherwise(F.col("component")),
            "blocks": F.when(small, 1).otherwise(F.ceil(F.col("s") / BLOCK)).cast("int"),
            "large": ~small,
        }
    ).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    left = sized.select("large", "pack", F.col("own").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), F.lit(0).alias("side"), "component", "id", "m", "v")
    right = sized.select("large", "pack", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "component", "id", "m", "v")

    def count(block: pa.Table) -> pa.Table:
        side, c, ids, m = (block.column(k).to_numpy() for k in ("side", "component", "id", "m"))
        lengths = np.diff(np.asarray(block.column("v").combine_chunks().offsets)) if block.num_rows else np.zeros(0, int)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(a), np.int64)
        for d in np.unique(lengths):
            pick = np.flatnonzero(lengths == d)
            x = np.zeros((block.num_rows, d))
            x[pick] = unit(matrix(block.column("v").combine_chunks().take(pa.array(pick))))
            i, j = np.flatnonzero(lengths[a] == d), b[lengths[b] == d]
            for s in range(0, len(i), 1024):
                at = i[s : s + 1024]
                near = (x[a[at]] @ x[j].T >= threshold) & (c[a[at]][:, None] == c[j]) & (ids[a[at]][:, None] != ids[j])
                n[at] += near @ m[j]
        return pa.table({"id": pa.array(ids[a]), "n": pa.array(n)})

    counted = left.union(right).groupBy("large", "pack", "i", "j").applyInArrow(count, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, threshold: float = 0.9, aim: float = AIM, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row, once the audit has found enough of the true links (or has asked for more deals twice)."""
    for more in (1, 4, 16):
        out = table(descended(df, threshold, key=key, vector=vector, more=more, **how))
        if more == 16 or audit(df, out, threshold, key=key, vector=vector) >= aim:
            return out
        drop_table(out)


def descended(df: DataFrame, threshold: float = 0.9, floor: float = 0.6, room: int = LIST, most: int = MOST, rounds: int = 5, settled: float = 0.001, key: str = "vec_id", vector: str = "embedding", more: int = 1) -> DataFrame:
    """One run of steps 1 to 4, with cells that miss a pair at the threshold 0.002 / more times."""
    units, member = classes(df, key, vector)
    n = units.count()
    keyed = df.select(F.col(key).cast("long").alias("vec_id"))
    if not n:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = first_lists(units, n, threshold, floor, room, 17 * more, more=more)
    tied = lambda pairs: pairs.where("tie").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    seen = table(tied(cells).distinct())
    lists = table(trimmed(cells.drop("tie"), threshold, room, most))
    drop_table(cells)
    wide, before = room, lists.where(F.col("c") >= threshold).count()
    for turn in range(rounds):
        new = introduced(lists, units, threshold, floor, wide, turn)
        if new is None:
            break
        seen = table(seen.union(tied(new)).distinct())
        both = new.select("a", "b", "c").union(new.select("b", "a", "c"))
        saturated = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c")).where((F.col("c") >= threshold) & (F.col("n") >= wide)).limit(1).count()
        wide = min(most, wide * 2) if saturated else wide
        after = table(trimmed(lists.union(both).groupBy("a", "b").agg(F.max("c").alias("c")), threshold, room, wide))
        drop_table(lists)
        drop_table(new)
        lists = after
        now = lists.where(F.col("c") >= threshold).count()
        if now - before <= settled * now:
            break
        before = now
    a, b = units.select(F.col("id").alias("a"), F.col("v").alias("x")), units.select(F.col("id").alias("b"), F.col("v").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    cos = dot("x", "y") / F.sqrt(dot("x", "x")) / F.sqrt(dot("y", "y"))
    exact = lambda pairs: table(pairs.join(a, "a").join(b, "b").where(cos >= threshold).select("a", "b"))
    # lists hold single precision; what lies at the threshold is decided in double
    near = lists.where(F.col("c") >= threshold - CLOSE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = exact(near.union(seen).distinct())
    group = table(components(near))
    turn = rounds
    while True:
        size = group.groupBy("component").agg(F.count("*").alias("s"))
        sized = table(group.join(size, "component").select("id", "component", (F.col("s") > room).alias("large")))
        if not sized.where("large").limit(1).count():
            break
        turn += 1
        cells = first_lists(units, n, threshold, floor, room, 17 * more + turn, sized, more)
        outer = trimmed(cells.drop("tie"), threshold, room, room)
        new = introduced(lists.union(outer), units, threshold, floor, wide, turn)
        pairs = tied(cells) if new is None else tied(cells).union(tied(new))
        for side in ("a", "b"):
            pairs = pairs.join(group.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
        pairs = pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b").distinct()
        new_links = exact(pairs)
        drop_table(cells)
        if new is not None:
            drop_table(new)
        if not new_links.limit(1).count():
            break
        near = table(near.union(new_links))
        group = table(components(near))
    full = lists.where(F.col("c") >= threshold - CLOSE).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= room)
    dense = table(group.join(group.join(full, group["id"] == full["a"], "left_semi").select("component").distinct(), "component", "left_semi"))
    ends = near.distinct().select(F.col("a").alias("id"), F.col("b").alias("other")).union(near.distinct().select(F.col("b").alias("id"), F.col("a").alias("other")))
    sparse = ends.join(dense.select("id"), "id", "left_anti").join(units.select(F.col("id").alias("other"), "m"), "other").groupBy("id").agg(F.sum("m").alias("n"))
    inside = table(sparse.select("id", "n").union(links_within(units, dense, threshold).select("id", "n")))
    drop_table(near)
    drop_table(dense)
    drop_table(lists)
    each = member.join(units.select("id", "m"), "id").join(inside, "id", "left").join(group, "id", "left")
    each = each.select(F.col("vec"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.join(each, keyed["vec_id"] == each["vec"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def audit(df: DataFrame, result: DataFrame, threshold: float = 0.9, sample: int = AUDITED, key: str = "vec_id", vector: str = "embedding") -> float:
    """The share of true links of `sample` vectors (by a hash) that the result counts."""
    rows = df.where(usable(df, vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    by: dict[int, tuple[list, list]] = {}  # vectors of unlike lengths don't meet
    for r in got:
        ids, vectors = by.setdefault(len(r["v"]), ([], []))
        ids.append(r["id"])
        vectors.append(r["v"])
    sent = rows.sparkSession.sparkContext.broadcast({d: (np.array(ids), unit(np.array(v))) for d, (ids, v) in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("v").offsets)) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(lengths):
                if d in sent.value:
                    ids, q = sent.value[d]
                    own = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    hits = (q @ unit(matrix(own.column("v"))).T >= threshold) & (ids[:, None] != np.asarray(own.column("id")))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits.sum(axis=1))], names=["vec_id", "n"])

    true = rows.mapInArrow(run, "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))
    s = true.join(result.select("vec_id", "n_links").distinct(), "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return s[1] / s[0] if s[0] else 1.0


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
