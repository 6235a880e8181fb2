"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage works on all that the one before kept. Stages one to four return the columns of ``documents``; the last adds the tokens.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from benefold.llm import bpe, common, minhash_dedup, mixing, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).withColumn("_toxic", toxicity.score(model)).where("_toxic < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Rows without id or words stay; rows of one id are told apart by their texts."""
    return minhash_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that also start elsewhere."""
    out = suffix_dedup.remove_repeats(docs, carry=("lang", "source"), as_text=True)
    out = out.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "rest.lang", "rest.source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows of one id, source and size are alike to the mix; its decisions on them are dealt out in order of their texts."""
    same = ["_id", "_source", "_size", "_k"]
    alike = Window.partitionBy("_id", "_source", "_size")
    taken = mixing.mix(docs).select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    taken = taken.withColumn("_k", F.row_number().over(alike.orderBy(F.desc("_copies")))).where("_copies > 0")
    rows = docs.select(*COLUMNS, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), mixing.words(F.col("text")).alias("_size"))
    rows = rows.withColumn("_k", F.row_number().over(alike.orderBy(F.xxhash64("text"), "text")))
    taken = taken.withColumnsRenamed({c: f"{c}2" for c in same})
    out = rows.join(taken, functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}2")) for c in same)))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text."""
    out = bpe.round_trip(docs.select(*COLUMNS), out_col="_bytes")
    same = F.col("_bytes") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select(*COLUMNS, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("byte-level BPE", tokenize),
]
#: Similarity estimates, repeats of any place and merges aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
