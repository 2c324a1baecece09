"""A search index rebuilt from the stores of papers and passages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spindrift.operators.store import Store

Embed = Callable[[list[str]], np.ndarray]


def reindex(chunks: Store, papers: Store, target: Store, embed: Embed | None = None, model: str | None = None, nominal: bool = True) -> int:
    """Write every passage with its paper's metadata, and its vector if there is an ``embed``, to ``target``; returns their number.

    ``chunks`` has ``chunk_id, paper_id, text, embedding_model, embedding_dim``, ``papers`` has ``paper_id, title``.
    Passages without a paper are left out. ``target`` is keyed by ``chunk_id``; rows of passages that are
    gone stay there, as in a search index. Passages are embedded in tasks, a batch at a time, and a vector
    that is missing fails the run. Which model served is then noted on the passages, if ``target`` is the
    index that the nominal model names; a rebuild without vectors notes nothing. It may be run again.
    """
    rows = chunks.read().join(papers.read().select("paper_id", "title"), "paper_id").select("chunk_id", "paper_id", "title", "text")
    if embed is None:
        vector = F.lit(None).cast("array<double>")
    else:

        @F.pandas_udf("array<double>")
        def vectors(text: pd.Series) -> pd.Series:
            out = embed(text.fillna("").tolist())
            if len(out) != len(text):
                raise ValueError(f"{len(out)} vectors for {len(text)} passages")
            return pd.Series(list(out))

        vector = vectors("text")
    rows = rows.withColumn("embedding", vector).withColumn("embedding_model", F.lit(None if embed is None else model).cast("string"))
    n = rows.select("chunk_id").count()
    if target.version:
        target.upsert(rows, ["chunk_id"])
    else:
        target.create(rows)
    if embed is not None and nominal:
        served = target.read().select("chunk_id", F.lit(model).alias("model"), F.size("embedding").alias("dim"))
        chunks.change(served, ["chunk_id"], lambda held: noted(held, served))
    return n


def noted(held, served):
    """The passages with the model and the width of the vectors that were served for them."""
    named = served.select(F.col("chunk_id").alias("served_id"), F.col("model").alias("served_model"), F.col("dim").alias("served_dim"))
    out = held.join(named, held["chunk_id"] == named["served_id"], "left")
    return out.withColumns({"embedding_model": F.coalesce("served_model", "embedding_model"), "embedding_dim": F.coalesce("served_dim", "embedding_dim")}).select(*held.columns)
