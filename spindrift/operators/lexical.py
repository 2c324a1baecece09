"""Lexical search for batches of questions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import words
from spindrift.operators.ranking import FOUND, Best, top_k
from spindrift.session import scratch_path, small_side

#: Terms and questions that meet in one matrix; larger batches of questions are asked in blocks.
BLOCK_TERMS, BLOCK_QUESTIONS = 20_000, 512


def term_counts(docs: DataFrame, terms: DataFrame | None, id_col: str, text: Column) -> DataFrame:
    """``(id, term, tf, dl)``: only terms that some question has are kept, before any shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), words(text).alias("w")).withColumn("dl", F.size("w"))
    rows = rows.select("id", "dl", F.explode("w").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(words("query"))).alias("term"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(qid, id, score)`` of all documents that share a term, rounded to six places.

    The terms of a batch of questions are counted and broadcast if they are few; then documents are
    reduced to these terms on the map side, and one shuffle adds them up.
    """
    asked = query_terms(queries)
    few = asked.select("term").distinct()
    few = small_side(few, few.count())
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(words(text))).alias("avgdl"))
    tf = term_counts(docs, few, id_col, text)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").crossJoin(stats).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    part = F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(weights, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


def postings(docs: DataFrame, terms: list[str] | None, id_col: str, text: Column) -> DataFrame:
    """``(id, dl, terms, tfs)``: a document's length in words, its terms, and how often each stands in it.

    Texts are read once, a document at a time, so nothing is shuffled. With ``terms``, only those are
    kept; without, this is a whole index, to be written once and asked many times.
    """
    spark = docs.sparkSession
    known = None if terms is None else spark.sparkContext.broadcast(frozenset(terms))
    schema = pa.schema([("id", pa.int64()), ("dl", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[a-z0-9]+").findall
        for batch in batches:
            sizes, names, counts = [], [], []
            for lowered in batch.column(1).to_pylist():
                found = find(lowered or "")
                sizes.append(len(found))
                tally = Counter(found if known is None else filter(known.value.__contains__, found))
                names.append(list(tally))
                counts.append(list(tally.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(a, type=f.type) for a, f in zip((sizes, names, counts), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text).alias("t")).mapInArrow(run, "id long, dl long, terms array<string>, tfs array<int>")


def bm25_topk(docs: DataFrame | None, queries: DataFrame, k: int, id_col: str = "doc_id", text: Column | None = None, k1: float = 1.2, b: float = 0.75, eligible: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score, rank)``: the k best documents of each question, scores rounded to six places.

    Postings of the questions' terms are written once (or come from ``index``, a whole table of
    postings). Frequencies and lengths are counted over all of them; then every task scores its
    documents by a matrix product and keeps its k best of each question, and only these are
    shuffled. ``eligible`` ids restrict what may be found, not the statistics.
    """
    spark = queries.sparkSession
    asked: dict[int, list[str]] = {}
    for r in query_terms(queries).collect():  # a stated batch of questions
        asked.setdefault(r["qid"], []).append(r["term"])
    vocabulary = sorted({t for own in asked.values() for t in own})
    held = index if index is not None else postings(docs, vocabulary, id_col, text)
    if index is None:
        path = scratch_path(spark, "postings")
        held.write.parquet(path)
        held = spark.read.parquet(path)
    stats = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string") if vocabulary else None
    df = {} if wanted is None else {r["term"]: r["df"] for r in held.select(F.explode("terms").alias("term")).join(small_side(wanted, len(vocabulary)), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = {t: float(np.log((stats["n"] - n + 0.5) / (n + 0.5) + 1.0)) for t, n in df.items()}
    found = held if eligible is None else held.join(eligible.select(F.col(eligible.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    out = None
    for block in blocks_of(asked):
        names = sorted({t for q in block for t in asked[q] if t in idf})
        place = {t: i for i, t in enumerate(names)}
        weight = np.zeros((len(names), len(block)))
        for j, q in enumerate(block):
            for t in asked[q]:
                if t in place:
                    weight[place[t], j] = idf[t]
        shared = spark.sparkContext.broadcast((np.array(block, np.int64), place, weight, float(stats["avgdl"] or 1.0)))
        rows = found.mapInArrow(scorer(shared, k, k1, b), "qid long, id long, score double")
        out = rows if out is None else out.unionByName(rows)
    return top_k(spark.createDataFrame([], "qid long, id long, score double") if out is None else out, k)


def blocks_of(asked: dict[int, list[str]]) -> Iterator[list[int]]:
    """Questions in blocks of bounded numbers of questions and terms."""
    block, terms = [], set()
    for q in sorted(asked):
        if block and (len(block) >= BLOCK_QUESTIONS or len(terms | set(asked[q])) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        block.append(q)
        terms |= set(asked[q])
    if block:
        yield block


def scorer(shared, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, place, weight, average = shared.value
        best = Best(len(questions), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, dl = part.column(part.schema.get_field_index("id")).to_numpy(), part.column(part.schema.get_field_index("dl")).to_numpy()
                terms, tfs = part.column(part.schema.get_field_index("terms")), part.column(part.schema.get_field_index("tfs"))
                row = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
                column = np.fromiter((place.get(t, -1) for t in terms.flatten().to_pylist()), np.int64, len(row))
                tf, good = tfs.flatten().to_numpy().astype(np.float64), column >= 0
                row, column, tf = row[good], column[good], tf[good]
                shares = np.zeros((len(ids), weight.shape[0]))
                shares[row, column] = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl[row] / average))
                scores = shares @ weight
                best.add(ids, np.where(scores > 0, np.round(scores, 6), -np.inf).T)
        yield best.rows(questions, FOUND)

    return run


def best_field(docs: DataFrame, queries: DataFrame, id_col: str, fields: dict[str, float], k: int) -> DataFrame:
    """The k best documents of each question by their best field, each field with its weight.

    A document among the k best is among the k best of the field that counts for it, so only these are shuffled.
    """
    parts = [bm25_topk(docs, queries, k, id_col, F.col(f)).select("qid", "id", F.round(F.col("score") * weight, 6).alias("score")) for f, weight in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.repartition("qid", "id").groupBy("qid", "id").agg(F.max("score").alias("score")), k)  # see fuse


def all_terms(docs: DataFrame, queries: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Documents that hold every term of a question, with the share of the document that these are."""
    asked = query_terms(queries)
    few = asked.select("term").distinct()
    tf = term_counts(docs, small_side(few, few.count()), id_col, text)
    need = asked.groupBy("qid").agg(F.count("*").alias("need"))
    hits = tf.join(asked, "term").groupBy("qid", "id").agg(F.count("*").alias("have"), F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    return hits.join(need, "qid").where("have = need").select("qid", "id", F.round(F.col("tf") / F.col("dl"), 6).alias("score"))
