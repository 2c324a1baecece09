"""Retrieval for a batch of questions as one plan: variants, two arms, fusion, texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import overlap
from spindrift.operators.dense import cosine_topk
from spindrift.operators.filters import Filters, condition, sanitised
from spindrift.operators.fusion import fuse, rerank
from spindrift.operators.inverted import Inverted, search, search_fields
from spindrift.operators.ivf import VectorIndex, search_vectors
from spindrift.operators.lexical import bm25_topk
from spindrift.operators.positional import positional_topk

RECALL = 50
#: Variants that a question may have.
VARIANTS = 64


@dataclass(frozen=True)
class Backend:
    """Where a search reads: indexes by term, of one field or several with weights, or one whose terms must all occur
    (``every_term``), and an index of vectors if there is one (without filters, which are exact only on the vectors)."""

    fields: tuple[tuple[Inverted, float], ...]
    vectors: VectorIndex | None = None
    every_term: bool = False

    def lexical(self, queries: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
        if self.every_term:
            return positional_topk(self.fields[0][0], queries, k, eligible=eligible)
        if len(self.fields) == 1:
            return search(self.fields[0][0], queries, k, eligible)
        return search_fields(list(self.fields), queries, k, eligible)


def arms(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, recall: int = RECALL, eligible: DataFrame | None = None, index: DataFrame | None = None, backend: Backend | None = None) -> DataFrame:
    """``(qid, list_no, rank, id)``: the lexical list (0) and the dense list (1) of every question.

    ``eligible`` ids restrict both lists alike. ``index`` is a stored table of postings. A ``backend`` of
    stored indexes takes the place of reading documents and vectors.
    """
    if backend is not None:
        lexical = backend.lexical(queries, recall, eligible)
    else:
        lexical = bm25_topk(docs, queries, recall, "doc_id", F.col("text"), eligible=eligible, index=index)
    if backend is not None and backend.vectors is not None and eligible is None:
        dense = search_vectors(backend.vectors, query_vectors, recall)
    else:
        held = vectors if eligible is None else vectors.join(eligible.select(F.col(eligible.columns[0]).alias("vec_id")), "vec_id", "left_semi")
        dense = cosine_topk(held, query_vectors, recall)
    name = lambda found, no: found.select("qid", F.lit(no).alias("list_no"), "rank", "id")
    return name(lexical, 0).unionByName(name(dense, 1))


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, top: int = RECALL) -> DataFrame:
    return fuse(arms(docs, vectors, queries, query_vectors)).where(F.col("rank") <= top)


def retrieve_plans(papers: DataFrame, vectors: DataFrame, plans: DataFrame, plan_vectors: DataFrame, filters: Filters | None = None, top: int = RECALL, recall: int = RECALL) -> DataFrame:
    """``(qid, id, score, rank)`` of questions with several variants, under one set of filters.

    ``plans`` has ``(qid, variant_no, query)`` and ``plan_vectors`` ``(qid, variant_no, vector)``, up to
    ``VARIANTS`` of each question (a number beyond these is an error). All variants are searched in one batch, each in both arms, and all
    lists of a question are fused. A category that no shared paper has is dropped first; the other
    filters hold for both arms before anything is ranked, and do not change term statistics.
    """
    no = F.col("variant_no")
    fits = (no >= 0) & (no < VARIANTS)
    name = F.when(fits, F.col("qid").cast("long") * VARIANTS + no).otherwise(F.raise_error(F.concat(F.lit("no such variant: "), F.coalesce(no.cast("string"), F.lit("null"))))).alias("qid")
    eligible = None if filters is None else papers.where(condition(sanitised(filters, papers))).select("doc_id")
    lists = arms(papers, vectors, plans.select(name, "query"), plan_vectors.select(name, "vector"), recall, eligible)
    variant = F.pmod("qid", F.lit(VARIANTS))
    named = lists.select(F.expr(f"(qid - pmod(qid, {VARIANTS})) div {VARIANTS}").alias("qid"), (variant * 2 + F.col("list_no")).cast("int").alias("list_no"), "rank", "id")
    return fuse(named).where(F.col("rank") <= top)


def reranked(fused: DataFrame, docs: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """Fused candidates by the share of the question's tokens in their text."""
    held = fused.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(queries, "qid")
    return rerank(held, F.round(overlap("query", "text"), 6), top)


def judgements(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, id, grade)``: 2 where a document holds the question's passage; the document of the
    question's number has grade 1, the one a hundred on grade 0 (the highest grade counts).

    The passages are a stated set, checked for size; one automaton finds all of them in a pass over each text.
    """
    rows = queries.select("qid", "query").collect()
    if sum(len(r["query"]) for r in rows) > 64_000_000:
        raise ValueError("too many passages for one batch")
    shared = docs.sparkSession.sparkContext.broadcast([(r["qid"], r["query"]) for r in rows])
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, named = ahocorasick.Automaton(), {}
        for q, passage in shared.value:
            named.setdefault(passage, []).append(q)
        for passage, own in named.items():
            if passage:
                machine.add_word(passage, own)
        machine.make_automaton()
        every = named.get("", [])
        for batch in batches:
            found = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = {q for _, own in machine.iter(text or "") for q in own} if len(machine) else set()
                found += [(q, i) for q in [*hits, *every]]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], schema=schema)

    strong = docs.select("doc_id", "text").mapInArrow(run, "qid long, id long").withColumn("grade", F.lit(2))
    ids = docs.select(F.col("doc_id").alias("id"))
    weak = queries.select("qid", F.col("qid").alias("id"), F.lit(1).alias("grade")).unionByName(queries.select("qid", (F.col("qid") + 100).alias("id"), F.lit(0).alias("grade")))
    return strong.unionByName(weak.join(ids, "id", "left_semi").select("qid", "id", "grade")).groupBy("qid", "id").agg(F.max("grade").alias("grade"))


