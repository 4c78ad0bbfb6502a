"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets: the budget is shared by weight; a source stops at `most` times its size and the excess goes to the others by
weight. Documents are dealt to shards by a seeded hash; in each shard a source's documents, in seeded order, are a
stream of words cut into blocks of equal length. Each shard's blocks go to its sources by the highest quotients
target / (2 k + 1); a source gets its whole stream once or twice and then the first blocks of it up to its quota.

Only seats near a source's ideal share compete (by a bound that holds for every divisor method of this kind), so a
shard ranks a few rows for each source, not one for each block.

Rows: a null or empty text has size 0 and takes 0; a null source is a source, the last in order; a null doc_id is dealt by a hash of the text;
rows that share a doc_id are in order of size, then of a hash of the text; repeated rows are documents of their own; a very long text counts whole and may fill blocks alone; an empty table gives an empty one. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline.llm.common import WORD, table

#: Words in a block, and words after which another shard begins: so many keep a shard's streams small for one task.
BLOCK, SHARD_WORDS = 16, 250_000
#: Sources up to which their table (some tens of bytes each) is broadcast.
MOST_SOURCES = 20_000
ADDED = ("size", "source_size", "target", "taken")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row for each source: source_size, target, and total over all. Its windows rank sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    src = src.withColumns({"__cap": F.col("source_size") * most, "total": F.sum("source_size").over(Window.partitionBy())})
    by_limit = Window.orderBy((F.col("__cap") / F.col("__weight")).asc(), F.col("source").asc_nulls_last())
    src = src.withColumns(
        {
            "__before": F.coalesce(F.sum("__cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__left": F.sum("__weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    stopped = F.col("__cap") * F.col("__left") <= (F.col("total") * share - F.col("__before")) * F.col("__weight")
    src = src.withColumn("__stopped", stopped)
    every = Window.partitionBy()
    src = src.withColumns(
        {
            "__caps": F.coalesce(F.sum(F.when(F.col("__stopped"), F.col("__cap"))).over(every), F.lit(0)),
            "__weights": F.sum(F.when(~F.col("__stopped"), F.col("__weight"))).over(every),
        }
    )
    free = (F.col("total") * share - F.col("__caps")) * F.col("__weight") / F.col("__weights")
    return src.select("source", "source_size", F.when(F.col("__stopped"), F.col("__cap").cast("double")).otherwise(free).alias("target"), "total")


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """df (or the columns named by keep) with size, source_size, target and taken (words that the mix takes of the row, repeats counted)."""
    names = [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    tie = F.md5(F.coalesce("text", F.lit("")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), tie))))
    made = {"size": size, "__key": key, "__order": order, "__tie": tie}
    # words are counted once; what follows reads this table
    sized = table(df.withColumns(made).select(*names, *made))
    src = targets(sized.select(F.expr("substring(nullif(__key, ''), 2)").alias("source"), "size"), weights, share, most)
    src = table(src.withColumns({"__key": key, "__shards": F.greatest(F.lit(1), F.ceil(F.col("total") / shard_words))}).drop("source", "total"))
    number = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long")
    few = src.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES  # a row for each source; beyond that the join shuffles, and adaptive execution splits large sources
    rows = sized.join(F.broadcast(src) if few else src, "__key").withColumn("__shard", number % F.col("__shards"))

    # each shard's seats
    cells = rows.groupBy("__shard", "__key").agg(F.sum("size").alias("__c"), F.first("source_size").alias("__s"), F.first("target").alias("__t"))
    cells = cells.where("__c > 0").withColumn("__ideal", F.col("__t") * F.col("__c") / F.col("__s"))
    shard = Window.partitionBy("__shard")
    cells = cells.withColumns({"__n": F.count("*").over(shard), "__all": F.sum("__ideal").over(shard)})
    q, slack = F.col("__ideal") / block, F.col("__ideal") / F.col("__all") * (F.col("__n") + 3) / 2 + 1
    cells = cells.withColumns({"__low": F.greatest(F.lit(0), F.floor(q - slack)), "__high": F.ceil(q + slack)})
    cells = cells.withColumn("__open", F.floor(F.col("__all") / block + 0.000001).cast("long") - F.sum("__low").over(shard))
    rank = Window.partitionBy("__shard").orderBy(F.col("__quotient").desc(), (F.col("__key") == "").asc(), F.col("__key").asc())
    seats = cells.withColumn("__k", F.explode(F.expr("sequence(__low, __high)"))).withColumn("__quotient", F.col("__ideal") / (2 * F.col("__k") + 1))
    seats = seats.withColumn("__won", (F.row_number().over(rank) <= F.col("__open")).cast("long"))
    quota = seats.groupBy("__shard", "__key").agg((F.first("__low") + F.sum("__won")).alias("__seats"), F.first("__c").alias("__c"))
    quota = quota.select("__shard", "__key", "__c", F.least(F.col("__seats") * block, F.col("__c") * most).alias("__words"))

    # the streams
    stream = Window.partitionBy("__shard", "__key").orderBy("__order", "size", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__end", F.sum("size").over(stream)).join(quota, ["__shard", "__key"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("__end"), F.expr("__words % __c")) - (F.col("__end") - F.col("size")))
    taken = F.coalesce(F.expr("__words div __c") * F.col("size") + part, F.lit(0)).cast("long")
    return rows.select(*names, "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The mix as documents: each row as often as its words are taken; where a quota ends inside a document, it goes in if half of it is taken."""
    names = df.columns
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column is taken for one of the mix's own
    want = {n: f"c{i}" for i, n in enumerate(names)}
    held = plain.withColumns({n: F.col(want[n]) for n in ("doc_id", "text", "source")})
    out = mix(held, **how).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return out.select(*[F.col(want[n]).alias(n) for n in names])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


#: Written apart from the plan above: every seat of every shard competes, from the first on.
ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nosrc, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS ord, md5(coalesce(text, '')) AS tie
  FROM documents),
src AS (SELECT src, nosrc, sum(size)::BIGINT AS source_size FROM docs GROUP BY ALL),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY nosrc, src) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
                   (sum(source_size) OVER ())::BIGINT AS total FROM src),
limits AS (SELECT a.src, a.nosrc, a.source_size, a.w, a.total,
    coalesce((SELECT sum(2 * b.source_size) FROM weighed b WHERE (2 * b.source_size / b.w, b.nosrc, b.src) < (2 * a.source_size / a.w, a.nosrc, a.src)), 0) AS caps,
    (SELECT sum(b.w) FROM weighed b WHERE (2 * b.source_size / b.w, b.nosrc, b.src) >= (2 * a.source_size / a.w, a.nosrc, a.src)) AS ws
  FROM weighed a),
stops AS (SELECT *, 2 * source_size * ws <= (total * 1.5::DOUBLE - caps) * w AS stopped FROM limits),
target AS (SELECT src, nosrc, source_size, greatest(1, ceil(total / {SHARD_WORDS}))::BIGINT AS shards,
    CASE WHEN stopped THEN (2 * source_size)::DOUBLE
         ELSE (total * 1.5::DOUBLE - coalesce(sum(2 * source_size) FILTER (stopped) OVER (), 0)::BIGINT) * w
              / (sum(w) FILTER (NOT stopped) OVER ())::BIGINT END AS target
  FROM stops),
placed AS (SELECT d.*, t.source_size, t.target, ('0x' || substr(d.ord, 1, 8))::BIGINT % t.shards AS shard FROM docs d JOIN target t USING (src, nosrc)),
cells AS (SELECT shard, src, nosrc, sum(size)::BIGINT AS c, any_value(target) * sum(size)::BIGINT / any_value(source_size) AS ideal
  FROM placed GROUP BY ALL HAVING sum(size) > 0),
seats AS (SELECT shard, src, nosrc, ideal / (2 * k + 1) AS quotient
  FROM cells, unnest(range(0, ceil(2 * ideal / {BLOCK})::BIGINT + 40)) AS u(k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY quotient DESC, nosrc, src) AS place FROM seats),
size_of AS (SELECT shard, floor(sum(ideal) / {BLOCK} + 0.000001::DOUBLE) AS n FROM cells GROUP BY shard),
won AS (SELECT shard, src, nosrc, count(*) AS seats FROM ranked JOIN size_of USING (shard) WHERE place <= n GROUP BY ALL),
quota AS (SELECT c.shard, c.src, c.nosrc, c.c, least(coalesce(w.seats, 0) * {BLOCK}, 2 * c.c)::BIGINT AS words
  FROM cells c LEFT JOIN won w USING (shard, src, nosrc)),
streams AS (SELECT *, (sum(size) OVER (PARTITION BY shard, src, nosrc ORDER BY ord, size, tie ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM placed)
SELECT s.doc_id, s.size::BIGINT AS size, s.source_size, s.target,
       coalesce(q.words // q.c * s.size + greatest(0, least(s.stop, q.words % q.c) - (s.stop - s.size)), 0)::BIGINT AS taken
FROM streams s LEFT JOIN quota q USING (shard, src, nosrc)
"""
