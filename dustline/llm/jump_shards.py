"""Sharding by jump consistent hashing: a stable key alone decides the shard, and one more shard takes rows only into itself.

Rows: a null key is a key of its own; repeated rows fall into one shard and get slots of their own; a null text is an
empty one. Shards of an empty table are empty. Input columns that clash with the output's names don't matter, as only key and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline.llm.common import mix

#: Each shard's slots are counted in so many cells, so that a shard is never sorted by one task.
CELLS = 256


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each 64-bit key, by the published algorithm (Lamping and Veach, 2014), for all keys at once."""
    k = keys.astype(np.uint64, copy=True)
    b, j = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    at = np.arange(len(k))
    with np.errstate(over="ignore"):
        while len(at):
            b[at] = j[at]
            k[at] = k[at] * np.uint64(2862933555777941757) + np.uint64(1)
            j[at] = np.floor((b[at] + 1) * (float(1 << 31) / ((k[at] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            at = at[j[at] < shards]
    return b


def key_hash(keys: pd.Series) -> np.ndarray:
    """Integer keys by their 64-bit value, other keys by a hash of their text; null has one of its own."""
    if pd.api.types.is_integer_dtype(keys.dtype) or pd.api.types.is_float_dtype(keys.dtype):
        none = keys.isna().to_numpy()
        k = keys.fillna(0).astype("int64").to_numpy().view(np.uint64)
    else:
        import xxhash

        none = keys.isna().to_numpy()
        k = np.fromiter((xxhash.xxh64_intdigest("" if n else str(v)) for v, n in zip(keys, none)), np.uint64, len(keys))
    return np.where(none, np.uint64(0x5851F42D4C957F2D), mix(k + np.uint64(0x9E3779B97F4A7C15)))


def shard(df: DataFrame, shards: int, key: str = "doc_id", grow_by: int = 1, cells: int = CELLS) -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard) and grown_shard (with grow_by more shards).

    Slots: each shard is dealt into cells by a hash of key and row; a row's slot is its place in its cell plus the rows
    of the shard's earlier cells. The counts (shards x cells rows, whatever the input) are the only thing that is broadcast.
    """

    # long keys that hold nulls would reach pandas as doubles, so null travels as a flag
    integer = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")

    @F.pandas_udf("shard int, grown int")
    def place(keys: pd.Series, none: pd.Series) -> pd.DataFrame:
        h = key_hash(keys.where(~none, None) if not integer else keys)
        h = np.where(none.to_numpy(), np.uint64(0x5851F42D4C957F2D), h)
        return pd.DataFrame({"shard": jump(h, shards).astype("int32"), "grown": jump(h, shards + grow_by).astype("int32")})

    plain = F.coalesce(F.col(key), F.lit(0)).alias(key) if integer else F.coalesce(F.col(key).cast("string"), F.lit(""))
    names = [c for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    at = df.select(*names).withColumn("__to", place(plain, F.col(key).isNull()))
    at = at.select(*names, F.col("__to.shard").alias("shard"), F.col("__to.grown").alias("grown_shard"), F.pmod(F.xxhash64(*names), F.lit(cells)).cast("int").alias("__cell"))
    counts = at.groupBy("shard", "__cell").count()
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy("shard").orderBy("__cell")) - F.col("count")).drop("count")
    order = Window.partitionBy("shard", "__cell").orderBy(*[F.col(c).asc_nulls_first() for c in names])
    at = at.withColumn("__in", F.row_number().over(order) - 1)
    return at.join(F.broadcast(before), ["shard", "__cell"]).select(*names, "shard", (F.col("__before") + F.col("__in")).alias("slot"), "grown_shard")


def op10_jump_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards by the law of keys."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
