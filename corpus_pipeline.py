"""A corpus pipeline of five stages over documents: language identification, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last returns
what is encoded. run() writes each stage's result to a table in the shared folder and hands the reread table to the next stage.
Null and empty texts leave at the first stage, as they have no language; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustline.llm import byte_bpe, language_id, mixing, near_dup, passages
from dustline.llm.common import drop_table, table

#: Documents whose best language has a smaller pooled probability are rejected.
SURE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; a missing lang is filled in. Learns from rows that op9's query learns from."""
    network = language_id.fit(docs.where(~language_id.held_out(3, 1)))
    seen = language_id.predict(docs, network).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return seen.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id. Of rows that share a doc_id and text one stays."""
    kept = near_dup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(kept, docs["doc_id"] == kept["__id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that an earlier document holds are cut out."""
    return passages.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the packed ids and digests of ids and of the bytes that they decode to."""
    both = byte_bpe.encode(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"], decoded=True)
    return both.select("doc_id", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dup", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode_documents),
]

#: A trained network and the library's encoding aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        before, docs = docs, table(stage(spark, docs, sf_dir))
        if at:
            drop_table(before)
    return docs
