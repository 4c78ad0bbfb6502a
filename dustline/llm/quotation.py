"""Quotation linking: quoted passages of messages are joined to the messages that they come from, and conversations are put in reply order.

A line's quote level is the number of > marks that begin it (after at most three blanks; a blank may follow each mark; lines inside closed
``` fences have level 0). A passage is a run of lines of one level above 0; lines such as "On Monday Ann wrote:" right before a deeper
level belong to the quotation. A message's own text is the rest. Passages and own texts are normalised (case folded, white space joined)
and hashed whole; own texts also by paragraph, line and sentence, passages also by sentence, or by line where they are one sentence. A hash's original is the first message of the
conversation with it among its own text; it must come before the message that quotes. A passage is linked to the original of its whole
hash, else to the message with the most words of its sentences if those are at least half of its words (ties: the later message).

A message replies to the original of its linked passage of the lowest level (then the most words, then the later message); without one to
the message before it. Reply order is depth first: a message, then its replies in their order, each with its own replies.

Rows: messages of a conversation are in order of turn (null first), then by text. Null conversations are one conversation; repeated rows
are messages of their own; a null or empty text, or one of quotes alone, has an empty own text. An empty table gives an empty one. Other
input columns aren't read.

No conversation is gathered by one task: messages are range-sorted, runs of siblings are summed by cells of that sort, and levels and
positions are found by pointer doubling, in as many rounds as the logarithm of the longest chain of replies. Originals are one row for
each hash, so a passage that very many quote adds rows to one side of a join only, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline.llm.common import drop_table, pieces, table

MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
FENCE = re.compile(r"[ \t]{0,3}```")
WROTE = re.compile(r"\b(wrote|writes|said|schrieb|écrit|escribió|scrisse)\b.*:\s*$", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
LINE = re.compile(r"\r\n|\r|\n")
PARSED = "conv {conv}, turn {turn}, role string, own_text string, own_sha256 string, n_quotes int, units array<bigint>, quotes array<struct<no:int,level:int,words:int,whole:boolean,hash:bigint,of:int>>"


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) for each line."""
    lines = LINE.split(text)
    fences = [i for i, line in enumerate(lines) if FENCE.match(line)]
    fenced = set()
    for first, last in zip(fences[::2], fences[1::2]):
        fenced.update(range(first, last + 1))
    out = []
    for i, line in enumerate(lines):
        marks = None if i in fenced else MARKS.match(line)
        out.append((marks[1].count(">"), line[marks.end() :]) if marks else (0, line))
    return out


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text), in order."""
    text = text or ""
    if ">" not in text:
        return text.strip(), []
    lines = levels(text)
    kept = []
    deeper = 0  # level of the next line that isn't blank
    for level, line in reversed(lines):
        blank = not line.strip()
        if not blank and level < deeper and WROTE.search(line):
            continue  # deeper stays, as an attribution may take two lines
        kept.append((level, line))
        if not blank:
            deeper = level
    own, quotes, run, at = [], [], [], 0
    for level, line in reversed(kept):
        if level != at and run:
            quotes.append((at, "\n".join(run)))
            run = []
        at = level
        if level:
            run.append(line)
        else:
            own.append(line)
    if run:
        quotes.append((at, "\n".join(run)))
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(own)).strip(), [(level, q) for level, q in quotes if q.strip()]


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def digest(normalised: str) -> int:
    import xxhash

    got = xxhash.xxh3_64_intdigest(normalised.encode("utf-8", "surrogatepass"))
    return got - (1 << 64) if got >> 63 else got


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(normal(text)) if s]


def units(own: str) -> set[int]:
    """Hashes of an own text: whole, and of its paragraphs, lines and sentences."""
    if not own:
        return set()
    found = {normal(own)}
    for part in re.split(r"\n\s*\n", own):
        found.add(normal(part))
        found.update(sentences(part))
    for line in own.split("\n"):
        found.add(normal(line))
    found.update(sentences(own))
    found.discard("")
    return {digest(x) for x in found}


def quoted(passages: list[tuple[int, str]]) -> list[dict]:
    """Rows of hashes of the passages: each whole, and each of its sentences where it has several, else each of its lines where it has several."""
    out = []
    for no, (level, text) in enumerate(passages):
        whole = normal(text)
        of = len(whole.split())
        out.append({"no": no, "level": level, "words": of, "whole": True, "hash": digest(whole), "of": of})
        parts = sentences(text)
        if len(parts) == 1:
            parts = [x for x in map(normal, text.split("\n")) if x]
        if len(parts) > 1:
            out += [{"no": no, "level": level, "words": len(s.split()), "whole": False, "hash": digest(s), "of": of} for s in parts]
    return out


def parsed(messages: DataFrame, texts: bool) -> DataFrame:
    kinds = dict(messages.dtypes)
    schema = PARSED.format(**kinds)

    def work(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole):
                rows = [parse(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv"),
                        batch.column("turn"),
                        batch.column("role"),
                        pa.array([own if texts else None for own, _ in rows], pa.string()),
                        pa.array([hashlib.sha256(own.encode("utf-8", "surrogatepass")).hexdigest() for own, _ in rows], pa.string()),
                        pa.array([len(q) for _, q in rows], pa.int32()),
                        pa.array([sorted(units(own)) for own, _ in rows], pa.list_(pa.int64())),
                        pa.array([quoted(q) for _, q in rows], pa.list_(pa.struct([("no", pa.int32()), ("level", pa.int32()), ("words", pa.int32()), ("whole", pa.bool_()), ("hash", pa.int64()), ("of", pa.int32())]))),
                    ],
                    names=["conv", "turn", "role", "own_text", "own_sha256", "n_quotes", "units", "quotes"],
                )

    return messages.mapInArrow(work, schema)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with an id that grows in the order of the messages; its high bits (cell) name a range that one task holds."""
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    order = ["conv", "turn", "own_sha256", "__row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    return rows.withColumn("id", F.monotonically_increasing_id()).withColumn("cell", F.shiftright("id", 33).cast("int"))


def links(rows: DataFrame) -> DataFrame:
    """(id, n_linked, reply_to) of messages with linked passages."""
    asked = rows.where("n_quotes > 0").select("id", "conv", F.explode("quotes").alias("q")).select("id", "conv", "q.*")
    keys = asked.select(F.col("conv").alias("__conv"), F.col("hash").alias("__hash")).distinct()
    said = rows.select("id", "conv", F.explode("units").alias("hash"))
    said = said.join(keys, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("hash") == F.col("__hash")), "left_semi")
    first = said.groupBy(F.col("conv").alias("__conv"), F.col("hash").alias("__hash")).agg(F.min("id").alias("source"))
    met = asked.join(first, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("hash") == F.col("__hash"))).where("source < id")
    by_source = met.groupBy("id", "no", "source").agg(
        F.max("level").alias("level"), F.max("of").alias("of"), F.max("whole").alias("whole"), F.sum(F.when(~F.col("whole"), F.col("words")).otherwise(0)).alias("words")
    )
    good = by_source.where("whole OR 2 * words >= of")
    passages = good.groupBy("id", "no").agg(F.max("level").alias("level"), F.max(F.struct("whole", "words", "source")).alias("best"), F.max("of").alias("of"))
    pick = F.max(F.struct(-F.col("level"), F.when(F.col("best.whole"), F.col("of")).otherwise(F.col("best.words")), F.col("best.source").alias("source")))
    return passages.groupBy("id").agg(F.count("*").cast("int").alias("n_linked"), pick["source"].alias("reply_to"))


def before(rows: DataFrame) -> DataFrame:
    """(id, previous): the message before each in its conversation, found within cells, and between them by each cell's last."""
    inside = rows.withColumn("previous", F.lag("id").over(Window.partitionBy("conv", "cell").orderBy("id")))
    last = rows.groupBy("conv", "cell").agg(F.max("id").alias("last"))
    last = last.select(F.col("conv").alias("__conv"), F.col("cell").alias("__cell"), F.lag("last").over(Window.partitionBy("conv").orderBy("cell")).alias("last")).where("last IS NOT NULL")
    both = inside.join(last, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("cell") == F.col("__cell")), "left")
    return both.select("id", F.coalesce("previous", "last").alias("previous"))


def climb(now: DataFrame, adds: list[str], below: str | None = None) -> DataFrame:
    """Pointer doubling over (id, anc, ...): columns of adds are summed over all ancestors, column below over all descendants.

    anc is null once the root is passed. Each round is a table in the shared folder.
    """
    now = table(now)
    while not now.where("anc IS NOT NULL").isEmpty():
        up = now.select(F.col("id").alias("__id"), F.col("anc").alias("__anc"), *[F.col(c).alias(f"__{c}") for c in adds])
        going = now.where("anc IS NOT NULL").join(up, F.col("anc") == F.col("__id"))
        moved = going.select("id", F.col("__anc").alias("anc"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in adds], *([below] if below else []))
        after = moved.unionByName(now.where("anc IS NULL").select(*moved.columns))
        if below:
            more = now.where("anc IS NOT NULL").select(F.col("anc").alias("id"), below)
            after = after.unionByName(more, allowMissingColumns=True).groupBy("id").agg(F.max("anc").alias("anc"), *[F.max(c).alias(c) for c in adds], F.sum(below).alias(below))
        after = table(after)
        drop_table(now)
        now = after
    return now


def reply_order(tree: DataFrame) -> DataFrame:
    """(id, level, position) of a forest (id, cell, parent): depth first, siblings by id, positions from 0 in each tree."""
    sized = climb(tree.select("id", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level"), F.lit(1).cast("bigint").alias("size")), ["level"], "size")
    child = tree.where("parent IS NOT NULL").join(sized.select("id", "size"), "id")
    ahead = Window.partitionBy("parent", "cell").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    cells = child.groupBy(F.col("parent").alias("__parent"), F.col("cell").alias("__cell")).agg(F.sum("size").alias("size"))
    cells = cells.select("__parent", "__cell", F.sum("size").over(Window.partitionBy("__parent").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"))
    cells = cells.where("__ahead IS NOT NULL")
    placed = child.withColumn("off", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    placed = placed.join(cells, (F.col("parent") == F.col("__parent")) & (F.col("cell") == F.col("__cell")), "left")
    steps = placed.select("id", F.col("parent").alias("anc"), (F.col("off") + F.coalesce("__ahead", F.lit(0)) + 1).alias("position"))
    roots = tree.where("parent IS NULL").select("id", F.col("parent").alias("anc"), F.lit(0).cast("bigint").alias("position"))
    return sized.select("id", "level").join(climb(steps.union(roots), ["position"]).select("id", "position"), "id")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", texts: bool = True) -> DataFrame:
    """One row for each message: conv_id, turn, role, own_text (null unless texts), own_sha256, n_quotes, n_linked, quoted, reply_to_turn, level, position.

    n_quotes are its quoted passages, n_linked those with an original; quoted says whether reply_to_turn comes from one. level is
    the number of messages above it, position its place in the conversation's reply order, from 0.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = table(numbered(parsed(rows, texts)))
    slim = rows.select("id", "conv", "cell")
    tree = slim.join(before(slim), "id").join(links(rows), "id", "left")
    tree = table(tree.select("id", "cell", F.coalesce("reply_to", "previous").alias("parent"), F.col("reply_to").isNotNull().alias("quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))
    turns = rows.select(F.col("id").alias("__id"), F.col("turn").alias("reply_to_turn"))
    out = rows.drop("units", "quotes", "cell").join(tree.drop("cell"), "id").join(reply_order(tree), "id").join(turns, F.col("parent") == F.col("__id"), "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "own_text", "own_sha256", "n_quotes", "n_linked", "quoted", "reply_to_turn", F.col("level").cast("int").alias("level"), "position"
    )


def conversations(linked: DataFrame) -> DataFrame:
    """Conversations in reply order without quotes, as rows of text: conv_id, position, role, text; messages without own text are left out, places stay."""
    return linked.where("own_text <> ''").select("conv_id", "position", "role", F.col("own_text").alias("text"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations, linked; digests instead of texts."""
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"), texts=False).drop("own_text")
