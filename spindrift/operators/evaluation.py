"""Evaluation of several configurations of which some fail: whole ones, or for some questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import metrics
from spindrift.operators.lexical import bm25_topk
from spindrift.session import stored

METRICS = ("recall", "ndcg", "mrr")


@dataclass
class Configuration:
    """A way to rank: what it needs, its lists ``(qid, id, rank)``, and the questions it failed on ``(qid, error)``.

    Without lists it was not run, for ``reason``.
    """

    name: str
    needs: str
    ranked: DataFrame | None = None
    failures: DataFrame | None = None
    reason: str | None = None


def evaluate(configurations: list[Configuration], judged: DataFrame, k: int = 10) -> DataFrame:
    """A row for each configuration: ``config, needs, status, reason, n_queries, n_failed``, the means over all judged
    questions, in which a failure is a miss, and the means over the questions that did not fail (``*_answered``).

    The status is ``ran``, ``not run`` where there are no lists, or ``error`` where every question failed; then
    ``reason`` is the most frequent error.
    """
    spark = judged.sparkSession
    judged, out = stored(judged), None
    none = [F.lit(None).cast("double").alias(name) for m in METRICS for name in (m, f"{m}_answered")]
    for c in configurations:
        if c.ranked is None:
            one = spark.range(1).select(F.lit("not run").alias("status"), F.lit(c.reason).cast("string").alias("reason"), F.lit(0).cast("long").alias("n_queries"), F.lit(0).cast("long").alias("n_failed"), *none)
        else:
            ranked = stored(c.ranked.select("qid", "id", "rank"))
            each = metrics.recall(ranked, judged, k).join(metrics.ndcg(ranked, judged, k), "qid").join(metrics.reciprocal_rank(ranked, judged, k), "qid")
            failed = spark.createDataFrame([], "qid long, error string") if c.failures is None else c.failures.groupBy("qid").agg(F.min("error").alias("error"))
            each = each.join(failed, "qid", "left").withColumns({m: F.when(F.col("error").isNull(), F.col(m)).otherwise(0.0) for m in METRICS})
            means = [F.round(F.avg(F.when(F.col("error").isNull(), F.col(m)) if answered else F.col(m)), 6).alias(f"{m}_answered" if answered else m) for m in METRICS for answered in (False, True)]
            one = each.agg(F.count("*").alias("n_queries"), F.count("error").alias("n_failed"), F.mode("error", deterministic=True).alias("most"), *means)
            error = (F.col("n_failed") == F.col("n_queries")) & (F.col("n_failed") > 0)
            names = [name for m in METRICS for name in (m, f"{m}_answered")]
            one = one.select(F.when(error, "error").otherwise("ran").alias("status"), F.when(error, F.col("most")).alias("reason"), "n_queries", "n_failed", *[F.when(~error, F.col(n)).alias(n) for n in names])
        one = one.withColumns({"config": F.lit(c.name), "needs": F.lit(c.needs)})
        out = one if out is None else out.unionByName(one)
    return out


def chunking_scores(cut: dict[str, DataFrame], queries: DataFrame, judged: DataFrame, k: int = 10, recall_size: int = 50) -> DataFrame:
    """``(strategy, n_chunks, recall, ndcg)``: each strategy's passages ``(no, paper, text)`` are ranked for all questions,
    rolled up to papers by the first rank, and scored against judgements of papers ``(qid, id, grade)``."""
    judged, out = stored(judged), None
    for name, chunks in cut.items():
        chunks = stored(chunks)
        found = bm25_topk(chunks, queries, recall_size, "no", F.col("text")).join(chunks.select(F.col("no").alias("id"), "paper"), "id")
        first = found.groupBy("qid", F.col("paper").alias("id")).agg(F.min("rank").alias("first"))
        ranked = stored(first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("first")).alias("rank")))
        each = metrics.recall(ranked, judged, k).join(metrics.ndcg(ranked, judged, k), "qid")
        one = each.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg")).select(F.lit(name).alias("strategy"), F.lit(chunks.count()).cast("long").alias("n_chunks"), "recall", "ndcg")
        out = one if out is None else out.unionByName(one)
    return out


def strategies_of_note(results: DataFrame) -> DataFrame:
    """``(role, strategy)`` of results ``(strategy, n_chunks, ndcg)``: the best, the median, and the best for its number of
    passages; ties to the smaller name. Each is a place in a sorted table, so no task sees all rows."""
    results = stored(results)
    by_ndcg = results.orderBy(F.desc("ndcg"), "strategy")
    by_cost = results.orderBy((F.col("ndcg") / F.greatest("n_chunks", F.lit(1))).desc(), "strategy")
    pick = lambda role, rows: rows.limit(1).select(F.lit(role).alias("role"), "strategy")
    return pick("winner", by_ndcg).unionByName(pick("median", by_ndcg.offset(results.count() // 2))).unionByName(pick("efficient", by_cost))


def gate(value: Column, threshold: float, higher_is_better: bool = True) -> Column:
    """PASS or FAIL of a value against a threshold; a value that is missing was not run."""
    ok = value >= threshold if higher_is_better else value <= threshold
    return F.when(value.isNull(), "not run").when(ok, "PASS").otherwise("FAIL")


def against_published(each: DataFrame, metric: str, published: float, tolerance: float) -> DataFrame:
    """``(n_queries, mean, published, difference, verdict)``: the mean of a metric over all questions against a published
    value, which it has to come within ``tolerance`` of."""
    mean = each.agg(F.count("*").alias("n_queries"), F.round(F.avg(metric), 6).alias("mean")).withColumn("published", F.lit(published))
    difference = F.round(F.col("mean") - F.col("published"), 6)
    return mean.select("n_queries", "mean", "published", difference.alias("difference"), gate(F.abs(difference), tolerance, False).alias("verdict"))
