"""The best rows of each question: within a task, and over all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class Best:
    """The k best rows of each question so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids, self.scores = np.full((n, 0), -1), np.full((n, 0), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some rows for every question; ``-inf`` where a row is no candidate."""
        scores = np.hstack([self.scores, scores])
        ids = np.hstack([self.ids, np.broadcast_to(ids, (len(scores), len(ids)))])
        if ids.shape[1] > self.k:
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((scores >= least).sum(axis=1).max())  # ties are kept until they are ordered
            near = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
            ids, scores = np.take_along_axis(ids, near, 1), np.take_along_axis(scores, near, 1)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        self.ids, self.scores = ids, scores

    def rows(self, questions: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        i, j = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip((questions[i], self.ids[i, j], self.scores[i, j]), schema, strict=True)], schema=schema)


def top_k(scored: DataFrame, k: int, id_col: str = "id", score: str = "score") -> DataFrame:
    """The k best of each question, ties to the smaller id, with ranks from 1."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
