"""Substring dedup: paragraph MinHash banding, exact confirmation, removal by components; and equal stretches across paragraphs.

Words as in the other operators (runs of other characters than white space, A-Z lowered). A passage has at least `least` words: shorter
repeats are idioms and headings, which a cut would tear out of clean documents. Two kinds of passages are found:

- paragraphs: lines of at least `least` words. Those with equal sets of five-word shingles are one; 60 MinHash samples make 20 bands of 3 (a pair at a similarity of
  0.75 is missed once in 60,000 times); colliding lines are joined, confirmed by exact Jaccard similarity >= 0.75 and clustered, by near_dup.grouped:
  stars in buckets, then every pair of a bucket that is in different components, in blocks. So no pair of a bucket is left uncompared.
- stretches: equal runs of `least` words, wherever they stand in a line or across lines. Each such window is led by a block of 20 words in it that begins
  at the MinHash of the window's possible places, so equal windows have equal blocks at the same place. The stretch that a block's windows cover is its context:
  places with one block and one context have the same windows. Only where a block has several contexts are windows hashed one by one (96 bits), once for each
  context. So equal windows of two documents are found without exception, and rows follow blocks and different contexts, not copies. Equality is
  transitive, so no pairs are made: the smallest doc_id keeps a window, and windows in a row with one keeper are one passage.

Of a component of lines the first line (by doc_id, then place) stays. What repeats within one document only isn't touched.

Rows: null, empty and short texts have no passages; rows without doc_id take no part; rows that share a doc_id are versions of one document, told apart
by their texts; repeated rows are treated alike; long texts count whole; an empty table gives an empty one; a tie of places can't be, as places differ.
Only doc_id and text are read, and dedup() keeps all other columns but those named __spans, __id and __t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustline.llm import near_dup
from dustline.llm.common import U, WORD, Words, drop_table, map_arrow, pieces, table

LEAST, PERCENT, BLOCK, SAMPLES = 50, 75, 20, 64
#: Documents and passages up to which those to cut are broadcast (some tens of bytes each), so that texts stay where they are.
FEW_SPANS = 400_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def anchors(shingles: np.ndarray, run: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the last smallest hash (44 bits) of each run of so many shingles; for each, the first run that has it and how many have it."""
    if len(shingles) < run:
        return (np.zeros(0, np.int64),) * 3
    mask, out = U(2**20 - 1), []
    for s in range(0, len(shingles) - run + 1, step):
        part = shingles[s : s + step + run - 1]
        low = (part & ~mask) | (mask - np.arange(len(part), dtype=U))  # among equal ones the last is the smallest
        have = 1
        while 2 * have <= run:
            low, have = np.minimum(low[:-have], low[have:]), 2 * have
        if have < run:
            low = np.minimum(low[: have - run], low[run - have :])
        out.append(s + (mask - (low & mask)).astype(np.int64))
    at = np.concatenate(out)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # places never go back
    return at[first], first, np.diff(np.append(first, len(at)))


def word_starts(raw: bytes) -> np.ndarray:
    """Byte offsets of the words."""
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(~space & np.concatenate(([True], space[:-1])))


def lines(text: str) -> np.ndarray:
    """[first word, words] of each line with words."""
    n = np.array([len(x.split()) for x in text.encode("utf-8", "surrogatepass").split(b"\n")], np.int64)
    return np.column_stack((np.cumsum(n) - n, n))[n > 0]


def _joined(x: list, t) -> np.ndarray:
    return np.concatenate(x).astype(t) if x else np.zeros(0, t)


def paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t, pos, len) and signature of each line of at least `least` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                place, runs = [], []
                for i, t, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "t", "text"))):
                    r = None
                    for first, n in lines(text).tolist():
                        if n >= least:
                            if r is None:
                                r = Words(text).runs(5)
                            place.append((i, t, first, n))
                            runs.append(r[first : first + max(1, n - 4)])
                cols = [pa.array([p[k] for p in place], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                made = near_dup.signed(runs, SAMPLES)
                yield pa.RecordBatch.from_arrays([*cols, *made.values()], names=["doc_id", "t", "pos", "len", *made])

    return map_arrow(docs, run, "doc_id bigint, t bigint, pos int, len int, " + near_dup.SIGNED)


def line_texts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text): the words of each place (id, doc_id, t, pos, len)."""
    each = places.groupBy("doc_id", "t").agg(F.collect_list(F.struct("id", "pos", "len")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                ids, out = [], []
                for text, found in zip(*(part.column(c).to_pylist() for c in ("text", "found"))):
                    w = Words(text)
                    for m in found:
                        ids.append(m["id"])
                        out.append(w.norm[w.starts[m["pos"]] : w.ends[m["pos"] + m["len"] - 1]].decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])

    return map_arrow(docs.join(each, ["doc_id", "t"]).select("text", "found"), run, "id bigint, text string").dropDuplicates(["id"])


def similar_lines(docs: DataFrame, least: int, percent: int) -> DataFrame:
    """(doc_id, t, pos, len, component) of lines that are alike, if those of several documents are."""
    marked = table(paragraphs(docs, least).withColumn("id", F.monotonically_increasing_id()))
    sets = table(marked.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    own = table(marked.join(sets.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "keys", *near_dup.SKETCH))
    place = marked.select("id", "doc_id", "t", "pos", "len", "h1", "h2")
    group = near_dup.grouped(own, lambda ids: line_texts(place.join(ids, "id"), docs), percent, SAMPLES)
    several = sets.join(group, sets["rep"] == group["id"], "left").where("m > 1 OR component IS NOT NULL").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    several = table(several)
    placed = table(place.join(several, ["h1", "h2"]).select("doc_id", "t", "pos", "len", "component"))  # of repeated rows each
    across = placed.groupBy("component").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("component")
    across = table(across)
    out = table(placed.join(across, "component").distinct())
    for x in (marked, sets, own, group, several, placed, across):
        drop_table(x)
    return out


def blocks(docs: DataFrame, least: int) -> DataFrame:
    """(key, context, doc_id, t, win, wins): each block that leads windows of `least` words, a hash of all that they cover, the first of them and how many."""
    size = min(BLOCK, least)
    span = least - size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                keys, contexts, ids, ts, win, wins = [], [], [], [], [], []
                for i, t, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "t", "text"))):
                    w = Words(text)
                    if len(w) < least:
                        continue
                    starts = np.arange(len(w) - size + 1)
                    at, first, n = anchors(w.hashes(starts, np.minimum(starts + 4, starts + size - 1)), span)
                    keys.append(w.hashes(at, at + size - 1).view(np.int64))
                    contexts.append(w.hashes(first, first + n + least - 2).view(np.int64))
                    ids.append(np.full(len(at), i, np.int64))
                    ts.append(np.full(len(at), t, np.int64))
                    win.append(first)
                    wins.append(n)
                cols = [_joined(keys, np.int64), _joined(contexts, np.int64), _joined(ids, np.int64), _joined(ts, np.int64), _joined(win, np.int32), _joined(wins, np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "context", "doc_id", "t", "win", "wins"])

    return map_arrow(docs, run, "key bigint, context bigint, doc_id bigint, t bigint, win int, wins smallint")


def windows(several: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(hash, more, key, context, first, last, at, pos): hashes of the windows of one place of each context; at counts within the context, pos in the text."""
    each = several.groupBy(F.col("first").alias("doc_id"), "t").agg(F.collect_list(F.struct("key", "context", "last", "win", "wins")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "more", "key", "context", "first", "last", "at", "pos"]
        kinds = [np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
        for batch in batches:
            for part in pieces(batch):
                out = [[] for _ in names]
                found = part.column("found")
                offsets, flat = np.asarray(found.offsets), found.values
                field = {c: np.asarray(flat.field(c)) for c in ("key", "context", "last", "win", "wins")}
                for k, (i, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())):
                    w, own = Words(text), slice(offsets[k], offsets[k + 1])
                    n = field["wins"][own].astype(np.int64)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pos = np.repeat(field["win"][own], n) + at
                    made = w.hashes(pos, pos + least - 1).view(np.int64), w.checks(pos, pos + least - 1), *(np.repeat(field[c][own], n) for c in ("key", "context")), np.full(len(at), i), np.repeat(field["last"][own], n), at, pos
                    for x, y in zip(out, made):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(_joined(x, t)) for x, t in zip(out, kinds)], names=names)

    cut = docs.join(each, ["doc_id", "t"]).select("doc_id", "text", "found")
    return map_arrow(cut, run, "hash bigint, more int, key bigint, context bigint, first bigint, last bigint, at int, pos int")


def stretches(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t, pos, len, keeper, keeper_pos): maximal runs of windows that several documents hold, with one keeper each; the keeper's own are among them."""
    found = table(blocks(docs, least))
    crowd = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("context") != F.max("context")).alias("several")).where("a <> b").select("key", "several")
    # sums are tables of their own before they are joined, so that adaptive execution can split a common block's places
    crowd = table(crowd)
    shared = table(found.join(crowd, "key"))
    drop_table(found)
    drop_table(crowd)
    each = shared.groupBy("key", "context").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("t", "doc_id").alias("t"), F.min_by("win", "doc_id").alias("win"), F.first("wins").alias("wins"), F.first("several").alias("several")
    )
    each = table(each)
    # a block with one context: its smallest document keeps all its windows
    names = ["key", "context", "at", "n", "keeper", "keeper_pos"]
    alone = each.where("NOT several").select("key", "context", F.lit(0).alias("at"), F.col("wins").cast("int").alias("n"), F.col("first").alias("keeper"), F.col("win").alias("keeper_pos"))
    hashed = table(windows(each.where("several"), docs, least))
    held = hashed.groupBy("hash", "more").agg(F.min("first").alias("keeper"), F.max("last").alias("last_of_all"), F.min_by("pos", "first").alias("keeper_pos")).where("keeper <> last_of_all")
    held = table(held.drop("last_of_all"))
    met = table(hashed.join(held, ["hash", "more"]).select("key", "context", "at", "keeper", "keeper_pos"))
    row = F.col("at") - F.row_number().over(Window.partitionBy("key", "context", "keeper").orderBy("at"))
    parts = met.withColumn("row", row).groupBy("key", "context", "keeper", "row").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"), F.min("keeper_pos").alias("keeper_pos"))
    parts = table(alone.select(names).union(parts.select(names)))
    place = table(shared.join(parts, ["key", "context"]).select("doc_id", "t", (F.col("win") + F.col("at")).alias("pos"), "n", "keeper", "keeper_pos"))
    for x in (shared, each, hashed, held, met, parts):
        drop_table(x)
    # runs that follow each other with one keeper are one passage; no two of a text overlap, as each window has one leader
    by = Window.partitionBy("doc_id", "t", "keeper").orderBy("pos")
    place = place.distinct().withColumn("new", F.coalesce((F.lag(F.col("pos") + F.col("n")).over(by) < F.col("pos")).cast("int"), F.lit(1))).withColumn("row", F.sum("new").over(by))
    own = F.when(F.col("doc_id") == F.col("keeper"), F.min("pos")).otherwise(F.min("keeper_pos"))
    spans = place.groupBy("doc_id", "t", "keeper", "row").agg(F.min("pos").alias("pos"), (F.max(F.col("pos") + F.col("n")) - F.min("pos") + least - 1).alias("len"), own.alias("keeper_pos"))
    return table(spans.select("doc_id", "t", "pos", "len", "keeper", "keeper_pos"))


def repeated_passages(docs: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """One row for each place of a repeated passage: doc_id, first_word, n_words, kept, keeper_doc_id, keeper_word, component, kind, text_hash.

    kept is true where the passage stays (its keeper). component is the passage's number: that of its keeper's place. kind: paragraph or stretch.
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    similar = similar_lines(docs, least, percent)
    keeper = table(similar.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("k")))
    rows = similar.join(keeper, "component").select("doc_id", "t", "pos", "len", F.col("k.doc_id").alias("keeper"), F.col("k.pos").alias("keeper_pos"), F.lit("paragraph").alias("kind"))
    rows = rows.withColumn("kept", (F.col("doc_id") == F.col("keeper")) & (F.col("pos") == F.col("keeper_pos")))
    equal = stretches(docs, least).select("doc_id", "t", "pos", "len", "keeper", "keeper_pos", F.lit("stretch").alias("kind"), (F.col("doc_id") == F.col("keeper")).alias("kept"))
    names = ["doc_id", F.col("pos").alias("first_word"), F.col("len").alias("n_words"), "kept", F.col("keeper").alias("keeper_doc_id"), F.col("keeper_pos").alias("keeper_word")]
    return rows.unionByName(equal).select(*names, F.xxhash64("keeper", "keeper_pos").alias("component"), "kind", F.col("t").alias("text_hash"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans (first word, words), each with the white space behind it."""
    raw = text.encode("utf-8", "surrogatepass")
    at = word_starts(raw)
    out, done = [], 0
    for first, n in sorted(spans):
        if first >= len(at):
            continue
        start, end = int(at[first]), int(at[first + n]) if first + n < len(at) else len(raw)
        if start > done:
            out.append(raw[done:start])
        done = max(done, end)
    out.append(raw[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def dedup(docs: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """docs without what repeats: text (and n_chars, if there) change, documents of which nothing is left go, all else stays as it is."""
    spans = repeated_passages(docs, least, percent).where("NOT kept")
    each = table(spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__t")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("__spans")))
    found, words = each.agg(F.count("*"), F.sum(F.size("__spans"))).first()
    if (found or 0) + (words or 0) <= FEW_SPANS:
        each = F.broadcast(each)
    both = docs.join(each, (docs["doc_id"] == each["__id"]) & (F.xxhash64(docs["text"]) == each["__t"]), "left").drop("__id", "__t")

    @F.pandas_udf(T.StringType())
    def cut(text, spans):
        import pandas as pd

        return pd.Series([t if s is None or t is None else without(t, [(x["first_word"], x["n_words"]) for x in s]) for t, s in zip(text, spans)])

    changed = F.col("__spans").isNotNull()
    names = docs.columns
    kept = both.where(~changed).select(*names)
    new = both.where(changed).withColumn("text", cut("text", "__spans")).where(F.col("text").rlike(WORD))
    if "n_chars" in names:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.union(new.select(*names))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a passage of at least 50 words that other documents hold too. Documents without one don't occur."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
