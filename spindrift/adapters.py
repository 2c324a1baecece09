"""The relations of the retrieval model, read from a folder of tables.

``papers``: a generic document with title, authors, categories, date, and owner. ``vectors``: an
embedding with the provider that made it. ``questions``: the batch that lexical queries answer.
``turns``: question and answer pairs. Each has a twin in SQL (``*_SQL``) for tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.array("source").alias("authors"),
        F.array("lang", "source").alias("category"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("published_date"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).alias("owner"),
        "text",
        "doc_id",
    )


PAPERS_SQL = """papers AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title, [source] AS authors,
         [lang, source] AS category, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published_date,
         CASE WHEN doc_id % 10 = 0 THEN concat('s', CAST(doc_id % 3 AS VARCHAR)) END AS owner, text, doc_id
  FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("provider"))


VECTORS_SQL = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider
  FROM embeddings)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's answer that follows it."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("query"), "answer")


TURNS_SQL = """turns AS (
  SELECT conv_id, turn, query, answer FROM (
    SELECT conv_id, turn, role, text AS query, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
  WHERE role = 'user' AND next_role = 'assistant')"""
