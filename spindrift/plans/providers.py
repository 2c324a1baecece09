"""Providers by role: ladders of which the first rung that works serves a row, and rerankers on them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.embedding import hash_embed
from spindrift.functions.text import STOPWORDS

#: A scorer gives a number for each text, for one question.
Scorer = Callable[[str, list[str]], Sequence[float]]


@dataclass
class Registry:
    """Scorers by name, and for each role the names in the order in which they are tried."""

    scorers: dict[str, Scorer] = field(default_factory=dict)
    ladders: dict[str, list[str]] = field(default_factory=dict)

    def register(self, name: str, scorer: Scorer, *roles: str) -> None:
        """Add a scorer, as the last rung of these roles."""
        if name in self.scorers:
            raise ValueError(f"{name} is registered already")
        self.scorers[name] = scorer
        for role in roles:
            self.ladders.setdefault(role, []).append(name)

    def ladder(self, role: str, override: str | None = None) -> list[tuple[str, Scorer]]:
        """The rungs of a role. An override takes the place of the whole ladder: that one, and nothing else."""
        if role not in self.ladders:
            raise KeyError(f"no binding for role {role}")
        names = [override] if override else self.ladders[role]
        if unknown := [n for n in names if n not in self.scorers]:
            raise ValueError(f"unknown provider {unknown[0]}")
        return [(n, self.scorers[n]) for n in names]


def tokens(text: str) -> set[str]:
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in STOPWORDS}


def question_share(query: str, texts: list[str]) -> list[float]:
    """The share of the question's tokens that a text has."""
    own = tokens(query)
    return [len(own & tokens(t)) / len(own) if own else 0.0 for t in texts]


def text_share(query: str, texts: list[str]) -> list[float]:
    """The share of a text's tokens that the question has."""
    own = tokens(query)
    held = [tokens(t) for t in texts]
    return [len(own & h) / len(h) if h else 0.0 for h in held]


def hashed_cosine(query: str, texts: list[str]) -> list[float]:
    vectors = hash_embed([query, *texts])
    return (vectors[1:] @ vectors[0]).tolist()


#: The offline providers of this library.
REGISTRY = Registry()
REGISTRY.register("question_share", question_share, "rerank")
REGISTRY.register("hashed_cosine", hashed_cosine, "rerank")
REGISTRY.register("text_share", text_share)


def served(query: str, texts: list[str], rungs: list[tuple[str, Scorer]]) -> tuple[str | None, list[float] | None, str | None]:
    """Who served, its scores, and why the rungs before it did not."""
    reasons = []
    for name, scorer in rungs:
        try:
            scores = [float(x) for x in scorer(query, texts)]
            if len(scores) != len(texts):
                raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
            if not all(map(math.isfinite, scores)):
                raise ValueError("a score is not finite")
        except Exception as e:  # what a provider does wrong is a value here, and the next rung is tried
            reasons.append(f"{name}: {type(e).__name__}: {e}")
        else:
            return name, scores, "; ".join(reasons) or None
    return None, None, "; ".join(reasons) or None


def rerank_ladder(candidates: DataFrame, rungs: list[tuple[str, Scorer]], top: int = 8) -> DataFrame:
    """``(qid, id, rank, rerank_score, new_rank, served, reason)``.

    ``candidates`` are ``(qid, query, id, rank, text)``, a ranked list that was cut before for each question. A
    question's texts are scored together, in tasks, by the first rung that gives a finite number for each;
    ``reason`` tells what the rungs before it did. Where none does, the list stays as it was, cut and
    without scores, and ``served`` is null. Ties keep the old order.
    """
    items = candidates.groupBy("qid").agg(F.first("query").alias("query"), F.sort_array(F.collect_list(F.struct("rank", "id", F.coalesce("text", F.lit("")).alias("text")))).alias("items"))
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("rank", pa.int64()), ("rerank_score", pa.float64()), ("served", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name, scores, reason = served(row["query"] or "", [x["text"] for x in row["items"]], rungs)
                for i, x in enumerate(row["items"]):
                    out.append((row["qid"], x["id"], x["rank"], None if scores is None else float(np.round(scores[i], 6)), name, reason))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    kept = items.select(F.col("qid").cast("long").alias("qid"), "query", F.transform("items", lambda x: F.struct(x["rank"].cast("long").alias("rank"), x["id"].cast("long").alias("id"), x["text"].alias("text"))).alias("items"))
    scored = kept.mapInArrow(run, "qid long, id long, rank long, rerank_score double, served string, reason string")
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= top)


def role_ladders(bindings: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(role, rung, provider)`` from bindings ``(role, rung, provider)``: a role with an override has that one rung only."""
    named = overrides.where("provider is not null and provider <> ''").groupBy("role").agg(F.min("provider").alias("only"))
    held = bindings.join(named, "role", "left")
    ranked = held.withColumn("rung", F.row_number().over(Window.partitionBy("role").orderBy("rung")).cast("long"))
    return ranked.where("only is null or rung = 1").select("role", "rung", F.coalesce("only", "provider").alias("provider"))


#: An embedder gives a vector for each text.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed_ladder(texts: DataFrame, rungs: list[tuple[str, Embedder]], key: str, text: str = "text", batch: int = 256) -> DataFrame:
    """``(key, vector, provider, reason)``: each batch of texts by the first rung that gives a finite vector of one width for each.

    Where a whole batch fails on a rung, its texts are tried there one by one, so that a text that a provider cannot
    take does not send the others to the next one. A text that no rung takes has no vector and no provider. Vectors of
    different providers are of different spaces: a search compares those of one provider only. Equal texts
    are embedded once.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = pa.schema([("digest", pa.string()), ("vector", pa.list_(pa.float64())), ("provider", pa.string()), ("reason", pa.string())])

    def vectors(embed: Embedder, some: list[str]) -> list[list[float]]:
        out = [[float(x) for x in v] for v in embed(some)]
        if len(out) != len(some):
            raise ValueError(f"{len(out)} vectors for {len(some)} texts")
        if len({len(v) for v in out}) > 1 or not all(math.isfinite(x) for v in out for x in v):
            raise ValueError("a vector is not finite or of another width")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                some = [t or "" for t in part.column(1).to_pylist()]
                done: dict[int, tuple] = {}
                reasons: dict[int, list[str]] = {i: [] for i in range(len(some))}
                for name, embed in rungs:
                    left = [i for i in range(len(some)) if i not in done]
                    try:
                        done |= {i: (v, name) for i, v in zip(left, vectors(embed, [some[i] for i in left]), strict=True)}
                    except Exception:  # one by one, to find out which texts it is
                        for i in left:
                            try:
                                done[i] = (vectors(embed, [some[i]])[0], name)
                            except Exception as e:
                                reasons[i].append(f"{name}: {type(e).__name__}: {e}")
                rows = [(*done.get(i, (None, None)), "; ".join(reasons[i]) or None) for i in range(len(some))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[c] for r in rows], type=schema.field(c + 1).type) for c in range(3))], schema=schema)

    named = texts.select(F.col(key).cast(kind).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("digest", F.sha2(F.col("t").cast("binary"), 256))
    once = named.groupBy("digest").agg(F.first("t").alias("t")).mapInArrow(run, "digest string, vector array<double>, provider string, reason string")
    return named.select("k", "digest").join(once, "digest").select(F.col("k").alias(key), "vector", "provider", "reason")
