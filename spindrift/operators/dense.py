"""Vector search for batches of questions, exact, with numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranking import FOUND, Best, top_k

#: Numbers of questions that are shipped to all tasks at a time; larger batches are asked in blocks.
BLOCK_VALUES = 4_000_000


def finite(vector: Column | str) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def cosine_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(qid, id, score, rank)``: the k largest cosines of each question, rounded to six places.

    Questions ``(qid, vector)`` are shipped in blocks of bounded size; every task keeps its k best
    of each question, and only these are shuffled. A zero vector has a cosine of 0. Vectors that are
    null, hold null or non-finite components, or have another length than a question, are no
    candidates, and such questions find nothing.
    """
    spark = docs.sparkSession
    asked = queries.where(finite("vector")).select("qid", "vector").toArrow()
    lists = asked.column("vector").to_pylist()
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(lists):
        by_size.setdefault(len(v), []).append(i)
    held = docs.where(finite(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    out = None
    for size, places in sorted(by_size.items()):
        step = max(1, BLOCK_VALUES // max(size, 1))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            ids = np.array([asked.column("qid")[i].as_py() for i in some], np.int64)
            shared = spark.sparkContext.broadcast((ids, unit(np.array([lists[i] for i in some], np.float64))))
            rows = held.where(F.size("v") == size).mapInArrow(searcher(shared, k), "qid long, id long, score double")
            out = rows if out is None else out.unionByName(rows)
    return top_k(spark.createDataFrame([], "qid long, id long, score double") if out is None else out, k)


def searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = shared.value
        best = Best(len(asked), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                best.add(part.column(0).to_numpy(), np.round(q @ x.T, 6) + 0.0)
        yield best.rows(asked, FOUND)

    return run


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) if x.size else x.reshape(len(x), -1)
