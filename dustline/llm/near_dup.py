"""MinHash near-duplicates with odd sketches.

Words are runs of other characters than white space, A-Z lowered; a document's set holds its distinct shingles of five
words (the whole sequence if it has fewer). Documents whose sets agree in at least 75 of 100 of their union are linked;
components of links are groups, named by their smallest doc_id.

1. Documents with equal sets form a class; its smallest doc_id stands for it from here on, so exact copies cost nothing more.
2. Of 256 MinHash samples 60 make 20 bands of 3 (a pair at the threshold is missed by all of them once in 60,000 times, one at 0.8
   once in 1.7 million), and all make an odd sketch: a bitmap of 1024 bits in which each (sample, value) flips a bit, so that the population count of
   two bitmaps' XOR tells how many samples differ. A pair over the count that lies 4.5 deviations above that of the
   threshold (one in 300,000 pairs at the threshold) goes; this is a condition of a join, in the JVM.
3. Each set meets the smallest set that shares a bucket with it; pairs that the sketches allow are confirmed on the full sets. In buckets that then hold
   several components, each member meets one of another component, and again with another one (stars, so a bucket of n gives n pairs, not n squared).
4. Members of buckets that still hold several components get a larger odd sketch (1024 samples, 4096 bits) and their whole sets. Those outside a bucket's
   largest component are compared with all its members in blocks of bounded size; pairs of one component never meet, those over the same 4.5 deviations go,
   and the others are confirmed on the full sets within the block. Only links that join what was apart leave a block, so fewer than its members. So
   every pair of a bucket is either confirmed, refuted by the full sets or a sketch, or already in one component; no bucket is capped.

Rows: null, empty and blank texts have an empty set, are linked with nothing and stay; rows without doc_id are returned with no component and stay;
rows that share a doc_id are one document with the links of each; long texts count whole; an empty table gives an empty one. Ties don't matter:
links are symmetric, and the smallest doc_id names a group. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustline.llm.common import U, Words, components, drop_table, jaccard_parts, map_arrow, mix, pieces, table

SAMPLES, BANDED, ROWS, LONGS = 256, 60, 3, 16
#: Members that one hub is compared with in one place; a larger group has its hub in several.
SALT = 256
_rng = np.random.default_rng(90210)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def minhash(sets: np.ndarray, sizes: np.ndarray, xor: np.ndarray = _XOR, mul: np.ndarray = _MUL, step: int = 512) -> np.ndarray:
    """The samples [set, sample] of sets of hashes that stand one after the other; none is empty. Permutations are of 32 bits.

    Short sets are taken together, long ones a step at a time, so that what is computed at a time stays small.
    """
    flat = (sets >> U(32)).astype(np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.empty((len(sizes), len(xor)), np.uint32)
    i = 0
    while i < len(sizes):
        if sizes[i] > step // 2:
            low = np.full(len(xor), 2**32 - 1, np.uint32)
            for at in range(int(starts[i]), int(ends[i]), step):
                np.minimum(low, ((flat[None, at : min(at + step, int(ends[i]))] ^ xor[:, None]) * mul[:, None]).min(axis=1), out=low)
            out[i] = low
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        out[i:j] = np.minimum.reduceat((flat[starts[i] : ends[j - 1], None] ^ xor) * mul, starts[i:j] - starts[i], axis=0)
        i = j
    return out


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of so many samples [set, sample]; bands share no key but by chance."""
    with np.errstate(over="ignore"):
        b = mix(samples.astype(U) + U(1)).reshape(len(samples), -1, rows)
        key = np.broadcast_to(np.arange(1, b.shape[1] + 1, dtype=U) * U(0x9E3779B97F4A7C15), b.shape[:2])
        for i in range(rows):
            key = mix(key * U(0xD6E8FEB86659FD93) + b[:, :, i])
    return key


def odd_sketch(samples: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """The parity bitmaps of the samples [set, sample], as so many 64-bit words each."""
    n, bits = len(samples), 64 * longs
    with np.errstate(over="ignore"):
        bit = (mix(mix(samples.astype(U) + U(1)) + np.arange(samples.shape[1], dtype=U) * U(0xC2B2AE3D27D4EB4F)) % U(bits)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<u8")


def most_bits(similarity: float, samples: int = SAMPLES, bits: int = 64 * LONGS, deviations: float = 4.5) -> int:
    """The XOR population count so many deviations above that of two sets of this similarity.

    d samples differ: 2 d bits are flipped, of which bits / 2 * (1 - exp(-4 d / bits)) are odd; d is binomial.
    """
    mean, sd = samples * (1 - similarity), math.sqrt(samples * similarity * (1 - similarity))
    odd = lambda d: bits / 2 * (1 - math.exp(-4 * d / bits))
    slope = 2 * math.exp(-4 * mean / bits)
    own = math.sqrt(bits / 4 * (1 - math.exp(-8 * mean / bits)) * 0.5)
    return math.ceil(odd(mean) + deviations * math.hypot(slope * sd, own))


def similarity_of_bits(count: int, samples: int = SAMPLES, bits: int = 64 * LONGS) -> float:
    """The similarity that an XOR population count stands for."""
    return 1 + bits / (4 * samples) * math.log(max(1e-9, 1 - 2 * count / bits))


SKETCH = [f"o{i}" for i in range(LONGS)]
#: Samples and bits of the larger sketch; members, and shingles of their sets together, that are compared at a time; blocks of that size in a pack.
FINE, FINE_BITS, BLOCK, BLOCK_SHINGLES, PACK = 1024, 4096, 1024, 1 << 20, 4
_fine = np.random.default_rng(60607)
_FINE_XOR = _fine.integers(0, 2**32, FINE, dtype=np.uint32)
_FINE_MUL = _fine.integers(0, 2**32, FINE, dtype=np.uint32) | np.uint32(1)


def fine_sketches(texts: DataFrame) -> DataFrame:
    """(id, keys, n, fine, shingles): the larger odd sketch and the whole sorted set of each text (id, keys, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                s = [Words(t).shingles() for t in part.column("text").to_pylist()]
                n = np.array([len(x) for x in s], np.int64)
                fine = np.zeros((len(n), FINE_BITS // 64), "<u8")
                for at in range(0, len(n), 64):
                    some = at + np.flatnonzero(n[at : at + 64])
                    if len(some):
                        fine[some] = odd_sketch(minhash(np.concatenate([s[i] for i in some]), n[some], _FINE_XOR, _FINE_MUL, 128), FINE_BITS // 64)
                cols = [part.column("id"), part.column("keys"), pa.array(n, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (fine, s))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "keys", "n", "fine", "shingles"])

    return map_arrow(texts.select("id", "keys", "text"), run, "id bigint, keys array<bigint>, n int, fine binary, shingles binary")


def joining(block: pa.Table, percent: int) -> pa.Table:
    """(a, b) of links in a block that join components, of which none is implied by the others.

    Rows: large, side, here, id, component, n, fine, shingles, keys. A pair is compared under the smallest open key that both have (keys), where the
    block holds it (here).
    """
    limit, two = most_bits(percent / 100, FINE, FINE_BITS), block.column("large")[0].as_py()
    ids, root, n, side = (block.column(c).to_numpy() for c in ("id", "component", "n", "side"))
    here = block.column("here").combine_chunks()
    key, row = here.flatten().to_numpy(), np.repeat(np.arange(len(ids)), here.value_lengths().to_numpy())
    root = root.copy()
    bits = np.frombuffer(b"".join(block.column("fine").to_pylist()), "<u8").reshape(len(ids), -1)
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in block.column("shingles")]
    keys = [frozenset(k) for k in block.column("keys").to_pylist()]
    a, b = [], []
    order = np.argsort(key, kind="stable")
    for m in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        at, m = key[m[0]], row[m]
        x, y = (m[side[m] == 0], m[side[m] == 1]) if two else (m, m)
        for i in x:
            js = y[root[y] != root[i]]
            if not two:
                js = js[ids[js] > ids[i]]
            js = js[np.minimum(n[js], n[i]).astype(np.int64) * 100 >= np.maximum(n[js], n[i]).astype(np.int64) * percent]
            if not len(js):
                continue
            for j in js[np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1) <= limit]:
                if root[i] == root[j] or min(keys[i] & keys[j]) != at:
                    continue
                both, either = jaccard_parts(sets[i], sets[j])
                if either and 100 * both >= percent * either:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    root[root == root[j]] = root[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def across(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of linked ids in one bucket but different components, confirmed on the full sets: enough of them to join what belongs together. A table.

    rest: (key, id, size, component, main, members, strays, shingles, stray_shingles). Buckets of up to BLOCK members and BLOCK_SHINGLES shingles are packed together,
    those of one main component first, as they hold mostly the same members: a member goes to a pack once. A pack has about PACK times as many members. In larger
    buckets blocks of strays (members outside the main component) meet blocks of all members, so rows grow with strays times members over BLOCK.
    """
    open_keys = rest.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    fine = table(fine_sketches(texts.join(open_keys, "id")))
    stray = F.col("component") != F.col("main")
    parts = lambda n, words, most=1: F.ceil(F.greatest(F.col(n) / (most * BLOCK), F.col(words) / (most * BLOCK_SHINGLES), F.lit(1))).cast("int")
    dealt = rest.select("key", "id", "component", "main", "size", parts("members", "shingles").alias("all"), parts("strays", "stray_shingles").alias("apart"))
    few, crowd = dealt.where("all = 1"), dealt.where("all > 1").join(fine, "id").select("*", F.array("key").alias("here"), F.lit(True).alias("large"), F.col("key").alias("pack"))
    # the members of one main component's buckets go to as many packs as they need; most need a part of one
    mains = few.groupBy("main").agg(F.count("*").alias("members"), F.sum("size").alias("shingles")).select("main", "members", "shingles", parts("members", "shingles", PACK).alias("split"))
    mains = table(mains)
    members, shingles = mains.agg(F.sum("members"), F.sum("shingles")).first()
    packs = 1 + max((members or 0) // BLOCK, (shingles or 0) // BLOCK_SHINGLES) // PACK
    split = table(mains.where("split > 1").select("main", "split"))
    drop_table(mains)
    pack = F.xxhash64("main", F.pmod(F.xxhash64("key"), F.coalesce("split", F.lit(1))))
    once = few.join(split, "main", "left").groupBy(F.pmod(pack, F.lit(packs)).alias("pack"), "id", "component").agg(F.collect_list("key").alias("here"))
    cols = ["large", "pack", "i", "j", "side", "here", "id", "component", "n", "fine", "shingles", "keys"]
    deal = lambda by, n: F.pmod(F.xxhash64("id", F.lit(by)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    small = once.join(fine, "id").withColumns({"large": F.lit(False), "i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}).select(cols)
    left = crowd.where(stray).withColumns({"i": deal(0, "apart"), "j": every("all"), "side": F.lit(0)}).select(cols)
    right = crowd.withColumns({"j": deal(1, "all"), "i": every("apart"), "side": F.lit(1)}).select(cols)
    blocks = small.union(left).union(right).groupBy("large", "pack", "i", "j")
    out = table(blocks.applyInArrow(lambda block: joining(block, percent), "a bigint, b bigint"))
    for t in (fine, split):
        drop_table(t)
    return out


SIGNED = "n int, h1 bigint, h2 bigint, keys array<bigint>, " + ", ".join(f"{c} bigint" for c in SKETCH)


def signed(runs: list[np.ndarray], samples: int = SAMPLES, banded: int = BANDED) -> dict[str, pa.Array]:
    """For each list of hashes, of which repeats don't count: its set's size, its 128-bit name, keys of bands and sketch. The sketch takes `samples`, of which the first `banded` make bands."""
    sizes = np.array([len(r) for r in runs], np.int64)
    flat, of = np.concatenate([*map(np.sort, runs), np.zeros(0, U)]), np.repeat(np.arange(len(runs)), sizes)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    flat, n = flat[new], np.bincount(of[new], minlength=len(runs))
    some = np.flatnonzero(n)
    names, odd = np.zeros((2, len(runs)), U), np.zeros((len(runs), LONGS), U)
    keys = np.zeros(0, U)
    if len(some):
        starts = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            names[0, some], names[1, some] = np.add.reduceat(flat, starts), np.add.reduceat(mix(flat + U(0xA0761D6478BD642F)), starts)
        low = minhash(flat, n[some], _XOR[:samples], _MUL[:samples])
        keys = band_keys(low[:, :banded]).ravel()
        for at in range(0, len(some), 256):
            odd[some[at : at + 256]] = odd_sketch(low[at : at + 256])
    ends = np.concatenate(([0], np.cumsum((n > 0) * (banded // ROWS)))).astype(np.int32)
    out = [pa.array(n, pa.int32()), *(pa.array(x.view(np.int64)) for x in names), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))]
    return dict(zip(["n", "h1", "h2", "keys", *SKETCH], [*out, *(pa.array(np.ascontiguousarray(odd[:, i]).view(np.int64)) for i in range(LONGS))]))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (the set's 128-bit name), keys of bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                made = signed([Words(t).runs(5) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made.values()], names=["doc_id", *made])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, " + SIGNED)


def alike(percent: int, a: str = "a", b: str = "b", samples: int = SAMPLES):
    """The condition on sizes and sketches of two sides of a join."""
    bits = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{a}.o0").bitwiseXOR(F.col(f"{b}.o0"))))
    sizes = F.least(f"{a}.n", f"{b}.n").cast("long") * 100 >= F.greatest(f"{a}.n", f"{b}.n").cast("long") * percent
    return sizes & (bits <= most_bits(percent / 100, samples))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets agree in percent of 100 of their union.

    Every b's text goes to its a, in lots of about SALT, sorted so that the text of a comes first in its lot; a task holds one a and one b at a time.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("lots"))
    dealt = pairs.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"))
    dealt = table(dealt)
    want = dealt.select("a", "lot", F.col("b").alias("id"), F.lit(1).alias("role")).union(
        dealt.select("a", "lot").distinct().select("a", "lot", F.col("a").alias("id"), F.lit(0).alias("role"))
    )
    rows = want.join(texts, "id").repartition("a", "lot").sortWithinPartitions("a", "lot", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            for part in pieces(batch):
                a, b = [], []
                for x, lot, role, y, t in zip(*(part.column(c).to_pylist() for c in ("a", "lot", "role", "id", "text"))):
                    if at != (x, lot):
                        at, own = (x, lot), []
                    s = Words(t).shingles()
                    if role == 0:
                        own.append(s)  # several only where rows share a doc_id
                        continue
                    for o in own:
                        both, either = jaccard_parts(o, s)
                        if 100 * both >= percent * either and either:
                            a.append(x)
                            b.append(y)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    out = table(map_arrow(rows.select("a", "lot", "role", "id", "text"), run, "a bigint, b bigint"))
    drop_table(dealt)
    return out


def grouped(own: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, samples: int = SAMPLES, stars: int = 2) -> DataFrame:
    """(id, component) of the sets that are linked with another one: a table.

    own: (id, n, keys, sketch) of distinct sets. texts_of gives (id, text) for a table of ids.
    """
    band = own.select("id", F.col("n").alias("size"), F.explode("keys").alias("key"))
    full = band.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last")
    # sums are tables of their own before they are joined, so that adaptive execution can split a common key
    full = table(full.select("key", "hub"))
    crowd = table(band.join(full, "key"))  # members of buckets with several
    drop_table(full)
    sketch = own.select("id", "n", *SKETCH)
    texts = table(texts_of(crowd.select("id").distinct()))

    def linked(pairs: DataFrame) -> DataFrame:
        a = sketch.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", *SKETCH)])
        both = pairs.join(a, "a").join(sketch.withColumnRenamed("id", "b"), "b")
        both = both.select(F.struct(F.col("a").alias("id"), *[F.col(f"a_{c}").alias(c) for c in ("n", *SKETCH)]).alias("a"), F.struct(F.col("b").alias("id"), "n", *SKETCH).alias("b"))
        return confirmed(both.where(alike(percent, samples=samples)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), texts, percent)

    def merged(group: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components so far, with the new links."""
        edges = links if group is None else links.union(group.select(F.col("id").alias("a"), F.col("component").alias("b")))
        out = table(components(edges))
        for t in (group, links):
            if t is not None:
                drop_table(t)
        return out

    # a set's smallest hub first: groups of near copies come together by one pair for each member
    pairs = crowd.groupBy("id").agg(F.min("hub").alias("a")).where("a <> id").select("a", F.col("id").alias("b"))
    group, rest = merged(None, linked(pairs)), crowd.select("key", "id", "size")
    for turn in range(stars + 1):
        placed = table(rest.groupBy("key", "id").agg(F.max("size").alias("size")).join(group, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component")))
        # a bucket's largest component needs no comparison within itself; a bucket of one component is done with
        who = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"w{i}") for i in range(2)]
        counts = placed.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("size").alias("s"), *who)
        open_ = counts.groupBy("key").agg(F.max(F.struct("m", "component", "s")).alias("top"), F.sum("m").alias("members"), F.sum("s").alias("shingles"), F.count("*").alias("kinds"), *[F.bit_xor(f"w{i}").alias(f"w{i}") for i in range(2)])
        # near copies share many buckets with the same members: one of these is enough
        same = open_.where("kinds > 1").groupBy("w0", "w1", "members").agg(F.min("key").alias("key"), F.min_by("top", "key").alias("top"), F.min_by("shingles", "key").alias("shingles"))
        open_ = same.select("key", F.col("top.component").alias("main"), "members", (F.col("members") - F.col("top.m")).alias("strays"), "shingles", (F.col("shingles") - F.col("top.s")).alias("stray_shingles"))
        open_, before = table(open_), rest
        rest = table(placed.join(open_, "key"))
        for t in (before, placed, open_):
            drop_table(t)
        if not rest.limit(1).count():
            break
        if turn == stars:
            group = merged(group, across(rest, texts, percent))
            break
        order = F.xxhash64(F.col("id"), F.lit(turn))
        hubs = rest.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "component")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.component").alias("of"))
        pairs = rest.join(hubs, "key").where("component <> of").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        group = merged(group, linked(pairs.distinct()))
    for t in (crowd, texts, rest):
        drop_table(t)
    return group


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = table(signatures(docs))
    named = signs.where("n > 0 AND doc_id IS NOT NULL")
    classes = table(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    rows = table(signs.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
    own = table(named.join(classes, ["h1", "h2"]).where("doc_id = rep").select(F.col("doc_id").alias("id"), "n", "keys", *SKETCH))
    drop_table(signs)
    drop_table(classes)
    group = grouped(own, lambda ids: docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"), percent)
    drop_table(own)
    out = rows.join(group, rows["rep"] == group["id"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
