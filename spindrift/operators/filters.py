"""Filters of a search, as conditions on the columns of papers, the same for every arm."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import words


@dataclass(frozen=True)
class Filters:
    """What a search is restricted to; None does not restrict. ``session`` sees shared rows and its own."""

    category: str | None = None
    author: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    session: str | None = None
    document: str | None = None


def visible(owner: Column, session: str | None) -> Column:
    """Shared rows, and a session's own."""
    return owner.isNull() | (owner == session) if session else owner.isNull()


def author_tokens(authors: Column | str, asked: str) -> Column:
    """Some name holds a word that was asked for."""
    return F.arrays_overlap(words(F.array_join(authors, " ")), words(F.lit(asked)))


def author_contains(authors: Column | str, asked: str) -> Column:
    """The list of authors, as JSON, holds the text, in any case."""
    return F.to_json(authors).ilike(f"%{asked}%")


def condition(filters: Filters, author=author_tokens) -> Column:
    """All filters at once, on ``category, authors, published_date, owner, paper_id``."""
    out = visible(F.col("owner"), filters.session)
    if filters.category is not None:
        out = out & F.array_contains("category", filters.category)
    if filters.author is not None:
        out = out & author("authors", filters.author)
    if filters.date_from is not None:
        out = out & (F.col("published_date") >= F.lit(filters.date_from).cast("date"))
    if filters.date_to is not None:
        out = out & (F.col("published_date") <= F.lit(filters.date_to).cast("date"))
    if filters.document is not None:
        out = out & (F.col("paper_id") == filters.document)
    return out


def categories(papers: DataFrame) -> DataFrame:
    """The categories of shared papers."""
    return papers.where("owner is null").select(F.explode("category").alias("category")).distinct()


def sanitised(filters: Filters, papers: DataFrame) -> Filters:
    """Without a category that no shared paper has; other filters stay."""
    if filters.category is None or not papers.where(F.col("owner").isNull() & F.array_contains("category", filters.category)).isEmpty():
        return filters
    return replace(filters, category=None)
