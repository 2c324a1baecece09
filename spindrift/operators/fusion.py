"""Reciprocal rank fusion, reranking, and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def fuse(ranked: DataFrame, k: int = K) -> DataFrame:
    """``(qid, id, score, rank)`` from lists ``(qid, list_no, rank, id)`` with ranks from 1.

    A list adds 1 / (k + rank). Ties keep the order in which ids first turn up, list by list.
    """
    # Lists are a union of tables that are each dealt out by question. Spark then takes the union as dealt
    # out alike, though adaptive execution may have merged the partitions of each in another way.
    ranked = ranked.repartition("qid")
    sums = ranked.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "id")
    return sums.select("qid", "id", "score", F.row_number().over(w).cast("long").alias("rank"))


def rerank(candidates: DataFrame, score: Column, top: int = 8) -> DataFrame:
    """Candidates ``(qid, id, rank, ...)`` by a new score; ties keep the old order."""
    scored = candidates.withColumn("rerank_score", score)
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= top)


def degrade(candidates: DataFrame, top: int = 8) -> DataFrame:
    """Without a reranker: the first candidates in their order, without scores."""
    return candidates.where(F.col("rank") <= top).select("qid", "id", "rank", F.lit(None).cast("double").alias("rerank_score"), F.lit(True).alias("degraded"))
