"""A training-corpus pipeline of five stages, each one of the operators of ``spindrift.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, language_id, line_dedup, mixing, simhash
from spindrift.llm.common import read_table, shared_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the language that its text has; those in which none is found are rejected.

    None is found in a null or empty text, or one without a letter. Null ids are predicted, repeated
    rows each stay, and an empty table, or one with nothing to learn from, gives an empty result.
    """
    out = language_id.identify(docs, keep=docs.columns)
    predicted = out.columns[-2]
    named = out.where(F.col(predicted) != "und").withColumn("lang", F.col(predicted))
    return named.select(*docs.columns)


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them; nulls, ids and repeats as in ``dedup_lines``."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates stays, and of its rows one; null ids stay.

    Null and empty texts are copies of one another. Of several rows with one id the one with the least
    hash stays, so reruns agree. An empty table gives an empty result.
    """
    groups = simhash.near_duplicates(docs)
    kept = groups.where("doc = component").select(F.col("doc").alias("doc_id"))
    held = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    some = held.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("kept_row"))
    return some.select("kept_row.*").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document is taken in part, once, or more than once.

    Nulls, empty texts and repeats as in ``mix_texts``.
    """
    return mixing.mix_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that the mix holds, with the decoded text's hash as a check; a row for each."""
    return bpe.bpe_round_trip(docs, bpe.vocabulary_path(), keep_ids=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_duplicate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Fingerprints, multinomial draws and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
