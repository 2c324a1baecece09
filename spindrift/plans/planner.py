"""Plans of questions: normalised text, expansions, filters and an intent, by a ladder of providers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import skip_rewrite

#: A planner gives a plan as JSON text, for instructions and a question.
Planner = Callable[[str, str], str]

# What a question can be after, and what it can be filtered by.
INTENTS = ("factual", "comparative", "multi_hop", "out_of_scope")
FILTERS = ("author", "category", "date_from", "date_to")

#: Attempts that a question has: the first rung, the next one, and so on; the last rung may be tried again.
ATTEMPTS = 3

PLAN = "normalized string, expansions array<string>, intent string, author string, category string, date_from string, date_to string, served string, degraded boolean, reason string"


def instructions(categories: Sequence[str] = ()) -> str:
    """What a planner is told. Known categories are named, so that it does not make one up."""
    known = f" A category has to be one of: {', '.join(sorted(categories))}." if categories else ""
    return (
        "Answer with a JSON object of four fields: normalized (the question in plain words), expansions (a list of other wordings), "
        f"filters (an object with any of {', '.join(FILTERS)}), and intent (one of {', '.join(INTENTS)}).{known}"
    )


def parse_plan(raw: str) -> dict:
    """The plan in a planner's answer; a ValueError says what is wrong with it."""
    try:
        found = json.loads(raw)
    except (TypeError, ValueError) as e:
        raise ValueError("the plan is not JSON") from e
    if not isinstance(found, dict):
        raise ValueError("the plan is not an object")
    expansions, filters = found.get("expansions", []), found.get("filters") or {}
    if not isinstance(found.get("normalized"), str) or found.get("intent") not in INTENTS:
        raise ValueError("the plan lacks a text or an intent")
    if not isinstance(expansions, list) or not all(isinstance(x, str) for x in expansions):
        raise ValueError("expansions are not texts")
    if not isinstance(filters, dict) or not all(v is None or isinstance(v, str) for v in map(filters.get, FILTERS)):
        raise ValueError("filters are not texts")
    for name in ("date_from", "date_to"):
        if filters.get(name):
            date.fromisoformat(filters[name])
    return {"normalized": found["normalized"], "expansions": expansions, "intent": found["intent"], **{n: filters.get(n) or None for n in FILTERS}}


def planned(query: str, rungs: list[tuple[str, Planner]], told: str) -> dict:
    """The first plan that can be read; without one the question as it stands, and why."""
    reason = None
    for n in range(ATTEMPTS if rungs else 0):
        name, planner = rungs[min(n, len(rungs) - 1)]
        try:
            return parse_plan(planner(told, query)) | {"served": name, "degraded": False, "reason": None}
        except Exception as e:  # the next attempt
            reason = f"{name}: {type(e).__name__}: {e}"
    return as_it_stands(query) | {"served": None, "degraded": True, "reason": reason or "no planner"}


def as_it_stands(query: str) -> dict:
    return {"normalized": query, "expansions": [], "intent": "factual"} | dict.fromkeys(FILTERS)


def plan_questions(queries: DataFrame, rungs: list[tuple[str, Planner]], categories: Sequence[str] = (), always: bool = False) -> DataFrame:
    """``(qid, query, normalized, expansions, intent, author, category, date_from, date_to, served, degraded, reason, skipped)``.

    Questions that say enough as they stand are not rewritten, unless ``always``. The others go to the rungs, up to
    three attempts, in tasks; equal questions are planned once. A question that no attempt plans stands as it is
    (``degraded``, with the last reason). A null question is an empty one.
    """
    told = instructions(categories)
    fields = [("digest", pa.string()), ("normalized", pa.string()), ("expansions", pa.list_(pa.string())), *((c, pa.string()) for c in ("intent", *FILTERS, "served")), ("degraded", pa.bool_()), ("reason", pa.string()), ("skipped", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, query, skipped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plan = as_it_stands(query) | {"served": None, "degraded": False, "reason": None} if skipped else planned(query, rungs, told)
                rows.append(plan | {"digest": digest, "skipped": skipped})
            yield pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], type=kind) for name, kind in fields], schema=schema)

    named = queries.select("qid", F.coalesce("query", F.lit("")).alias("query")).withColumn("digest", F.sha2(F.col("query").cast("binary"), 256))
    skips = F.lit(False) if always else F.coalesce(skip_rewrite("query"), F.lit(False))
    once = named.groupBy("digest").agg(F.first("query").alias("query")).select("digest", "query", skips.alias("skipped"))
    plans = once.mapInArrow(run, f"digest string, {PLAN}, skipped boolean")
    return named.join(plans, "digest").drop("digest")


def variants(plans: DataFrame) -> DataFrame:
    """``(qid, variant_no, query)`` of plans: the normalised question and its expansions, each wording once."""
    every = F.array_distinct(F.concat(F.array("normalized"), "expansions"))
    return plans.select("qid", F.posexplode(every).alias("variant_no", "query"))
