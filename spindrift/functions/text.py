"""Text functions as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as content.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "of", "to", "and", "or", "for", "with",
    "that", "this", "it", "as", "by", "be", "has", "have", "had", "from", "at", "which", "who", "what", "not",
)

# Words that mark a question as one about research.
ANCHORS = (
    "paper", "model", "dataset", "algorithm", "training", "evaluation", "benchmark", "method", "approach",
    "system", "study", "research", "results", "analysis", "experiment", "architecture", "retrieval",
    "embedding", "reasoning", "agent", "language", "corpus", "baseline", "metric", "accuracy",
    "performance", "framework", "pipeline", "task",
)

# Names that resolve a generic reference, and the phrases that make one.
ENTITY_NAMES = (
    "autodesign", "visdocagentbench", "gem", "ogr", "annoindex", "dept", "sc2r", "search-r1", "search r1",
    "posterbench", "promptriever", "schemaloop",
)
GENERIC_NAMES = (
    "the model", "the framework", "the system", "the approach", "the method", "the baseline", "the paper",
    "the algorithm", "it", "its",
)

# Answer texts, tags and patterns.
ABSTAIN_TEXT = "I don't have enough information in the retrieved context to answer this."
TOO_LARGE_TEXT = "That question is outside what this system accepts — please ask something shorter."
UNGROUNDED_TEXT = "I can't confirm this answer is well-supported by the retrieved papers, so I'm declining rather than risk giving you an unsupported claim."
DECLINE_TAG = "[DECLINED_TO_GUESS]"
CITATION = r"\[(\d+)[^\[\]]*\]"
PREMISE = r"(?i)premise.{0,60}(conflict|contradict|incorrect|is wrong|reversed|opposite|false)"
ABSENCE = r"(?i)\b(do not|does not|doesn't|no mention|not addressed|not discussed|not report|not claim|not describe)\b"
CONTEXT = r"(?i)\b(context|passages?)\b"
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def words(text: Column | str) -> Column:
    """All runs of ``[a-z0-9]`` of the lower-cased text, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Distinct content tokens: three characters or more, no stop words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def overlap(reference: Column | str, candidate: Column | str) -> Column:
    """Share of the reference's tokens that the candidate has; 0 if it has none."""
    own = tokens(reference)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(candidate))) / F.size(own))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column | str) -> Column:
    """Words between white space; 0 for blank text."""
    trimmed = strip(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def skip_rewrite(query: Column | str) -> Column:
    """At least six words, no bare short word in capitals, and a word that research questions share."""
    parts = F.split(strip(query), r"\s+")
    capital = F.exists(parts, lambda w: F.length(w).between(2, 4) & (w == F.upper(w)) & (w != F.lower(w)))
    anchors = F.array(*[F.lit(w) for w in ANCHORS])
    return (word_count(query) >= 6) & ~capital & F.arrays_overlap(tokens(query), anchors)


def any_word(names: tuple[str, ...]) -> str:
    return r"(?i)\b(" + "|".join(names) + r")\b"


def unresolved_reference(query: Column) -> Column:
    """The question names something generic and neither a known name nor an article id."""
    return query.rlike(any_word(GENERIC_NAMES)) & ~query.rlike(any_word(ENTITY_NAMES)) & ~query.rlike(r"\b\d{4}\.\d{4,5}\b")


def numbers(text: Column | str) -> Column:
    """Whole parts of the numbers in a text, thousands commas removed."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: F.floor(F.regexp_replace(n, ",", "").cast("double")).cast("long"))


def pairs(values: Column) -> Column:
    """Neighbouring values of an array as structs ``(a, b)``."""
    n = F.size(values)
    return F.when(n < 2, F.array().cast("array<struct<a:bigint,b:bigint>>")).otherwise(
        F.zip_with(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def transposed(query: Column, context: Column) -> Column:
    """The first neighbouring numbers of the question that the context has in reverse order only,
    as a struct ``(a, b)``; null if there are none."""
    own, other = pairs(numbers(query)), pairs(numbers(context))
    held = numbers(context)
    hits = F.filter(
        own,
        lambda p: (p["a"] != p["b"])
        & F.array_contains(held, p["a"])
        & F.array_contains(held, p["b"])
        & F.exists(other, lambda q: (q["a"] == p["b"]) & (q["b"] == p["a"]))
        & ~F.exists(other, lambda q: (q["a"] == p["a"]) & (q["b"] == p["b"])),
    )
    return F.when(F.size(hits) > 0, hits[0])


def plain_brackets(text: Column | str) -> Column:
    return F.translate(text, "【】［］", "[][]")


def cited(text: Column | str) -> Column:
    """Citation numbers in a text, distinct and in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda n: n.cast("long"))))


def declined(text: Column, note: Column, abstained: Column, tagged: Column, citations: Column) -> Column:
    """A flagged question was answered by a refusal to guess."""
    absent = text.rlike(ABSENCE) & text.rlike(CONTEXT)
    return note & ~abstained & (tagged | (citations == 0) | text.endswith("?") | text.rlike(PREMISE) | absent)


def content_id(owner: Column | str, text: Column | str) -> Column:
    """The id of a passage: a hash of its document's id and its text."""
    return F.sha2(F.concat(owner, text), 256)


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *[F.lower(strip(p)) for p in parts]), 256))
