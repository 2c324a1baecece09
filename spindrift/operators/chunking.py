"""Cutting documents into passages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import content_id

SIZE, OVERLAP = 1600, 200


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Start offsets of windows of ``size`` characters that overlap: in closed form, without a loop.

    An empty text has no window; the last one ends with the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: i * step)).otherwise(none)


def fixed_windows(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Passages of sections ``(paper_id, section_no, heading, text)``; offsets count over all sections of a paper."""
    rows = with_offsets(sections).withColumn("rel", F.explode(windows(F.col("text"), size, overlap)))
    part = F.substring("text", F.col("rel") + 1, F.lit(size))
    rows = rows.withColumn("part", part)
    return rows.select("paper_id", "section_no", "heading", F.col("part").alias("text"), (F.col("base") + F.col("rel")).alias("char_start"), (F.col("base") + F.col("rel") + F.length("part")).alias("char_end"), content_id("paper_id", F.col("part")).alias("chunk_id"))


def structure_aware(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A section that fits is one passage (blank ones are none); longer ones are cut into windows."""
    cut = fixed_windows(sections, size, overlap)
    fits = sections.select("paper_id", "section_no", (F.length("text") <= size).alias("fits"))
    return cut.join(fits, ["paper_id", "section_no"]).where(~F.col("fits") | F.col("text").rlike(r"\S")).drop("fits")


def with_offsets(sections: DataFrame) -> DataFrame:
    """Add ``base``: the characters of the sections before, with nothing between sections."""
    before = Window.partitionBy("paper_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("base", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def split_at(text: str, separators: tuple[str, ...], size: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size`` characters on natural boundaries.

    The text is cut at the first separator; neighbouring pieces merge while the span from the first
    to the last, separators included, fits. A piece too long alone is cut at the next separator, and
    at fixed places when none is left.
    """
    if len(text) <= size:
        yield 0, len(text)
        return
    usable = [s for s in separators if s in text]
    if not usable:
        yield from ((a, min(a + size, len(text))) for a in range(0, len(text), size))
        return
    mark, finer = usable[0], separators[separators.index(usable[0]) + 1 :]
    edges = [0, *(m.end() for m in re.finditer(re.escape(mark), text))]
    held: tuple[int, int] | None = None
    for start, following in zip(edges, [*edges[1:], len(text) + len(mark)], strict=True):
        end = following - len(mark)
        if end <= start:
            continue
        if (end - held[0] if held else end - start) <= size:
            held = (held[0] if held else start, end)
            continue
        if held:
            yield held
        held = (start, end) if end - start <= size else None
        if held is None:
            yield from ((start + a, start + b) for a, b in split_at(text[start:end], finer, size))
    if held:
        yield held


def recursive_separator(sections: DataFrame, size: int = SIZE) -> DataFrame:
    """Passages on paragraph, line or sentence ends; blank ones are dropped."""

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"a": a, "b": b} for a, b in split_at(t, ("\n\n", "\n", ". "), size) if t[a:b].strip()] if t else [])

    rows = with_offsets(sections).withColumn("span", F.explode(spans("text")))
    rows = rows.withColumn("part", F.expr("substring(text, span.a + 1, span.b - span.a)"))
    return rows.select("paper_id", "section_no", "heading", F.col("part").alias("text"), (F.col("base") + F.col("span.a")).alias("char_start"), (F.col("base") + F.col("span.b")).alias("char_end"), content_id("paper_id", F.col("part")).alias("chunk_id"))


def break_sentences(text: str, embed: Callable[[list[str]], np.ndarray], least: float, size: int) -> list[tuple[str, int, int]]:
    """Groups of sentences, cut where neighbours differ in meaning or the group is long enough."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(sentences) < 2:
        return [(text, 0, len(text))] if text.strip() else []
    v = embed(sentences)
    norm = np.linalg.norm(v, axis=1)
    both = norm[1:] * norm[:-1]
    alike = np.divide((v[1:] * v[:-1]).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0)
    groups, held = [[sentences[0]]], len(sentences[0])
    for sentence, similarity in zip(sentences[1:], alike, strict=True):
        if similarity < least or held >= size:
            groups.append([])
            held = 0
        groups[-1].append(sentence)
        held += len(sentence)
    out, cursor = [], 0
    for group in groups:
        joined = " ".join(group)
        start = text.find(group[0], cursor)
        start = cursor if start < 0 else start
        cursor = start + len(joined)
        out.append((joined, start, cursor))
    return out


def semantic(sections: DataFrame, embed: Callable[[list[str]], np.ndarray], least: float = 0.35, size: int = SIZE) -> DataFrame:
    """Passages of sentences that belong together by their embeddings."""

    @F.pandas_udf("array<struct<part:string,a:bigint,b:bigint>>")
    def groups(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"part": p, "a": a, "b": b} for p, a, b in break_sentences(t or "", embed, least, size)])

    rows = with_offsets(sections).withColumn("g", F.explode(groups("text")))
    return rows.select("paper_id", "section_no", "heading", F.col("g.part").alias("text"), (F.col("base") + F.col("g.a")).alias("char_start"), (F.col("base") + F.col("g.b")).alias("char_end"), content_id("paper_id", F.col("g.part")).alias("chunk_id"))


Chunker = Callable[[DataFrame], DataFrame]
Embed = Callable[[list[str]], np.ndarray]

#: Chunkers by name, each made from an embedding.
REGISTERED: dict[str, Callable[[Embed], Chunker]] = {
    "fixed_no_overlap": lambda embed: lambda s: fixed_windows(s, overlap=0),
    "fixed_overlap": lambda embed: fixed_windows,
    "recursive_separator": lambda embed: recursive_separator,
    "structure_aware": lambda embed: structure_aware,
    "semantic": lambda embed: lambda s: semantic(s, embed),
}


def register(name: str, make: Callable[[Embed], Chunker]) -> None:
    """Add a chunker; a name is given once."""
    if name in REGISTERED:
        raise ValueError(f"{name} is registered already")
    REGISTERED[name] = make


def strategies(embed: Embed) -> dict[str, Chunker]:
    """All registered chunkers by name."""
    return {name: make(embed) for name, make in REGISTERED.items()}


def dedup_by_id(chunks: DataFrame, order: list[str]) -> DataFrame:
    """One row for each chunk id: the values of its last occurrence at the place of its first."""
    w = Window.partitionBy("chunk_id")
    ranked = chunks.withColumn("last", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order])))
    firsts = F.first(F.struct(*order)).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("place", firsts).where("last = 1").drop("last")
