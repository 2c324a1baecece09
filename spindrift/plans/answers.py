"""From ranked passages to answers, for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as fx

#: Share of the question's tokens that the context must hold, and of the answer's for it to be grounded.
SUFFICIENT, GROUNDED = 0.4545, 0.5
MOST_CHARS = 2000
#: Passages of the first context, how many more each further attempt has, and the most there may be.
CONTEXT, WIDER, MOST_CONTEXT = 8, 4, 16
#: What a question is told for which no provider gives an answer.
DEGRADED_TEXT = "No answer can be given at the moment; the passages that were found are listed."
#: Outcomes that are refusals; a failure of the service is neither a refusal nor an answer.
REFUSALS = ("too_large", "out_of_scope", "abstained", "ungrounded")
#: Attempts that a question has.
ATTEMPTS = 2
#: Checks that only watch, or that act on what they find.
MODES = ("monitor", "enforce")
CANDIDATES = "array<struct<new_rank:bigint,id:bigint,text:string,paper:bigint,tokens:array<string>>>"


def guardrail_mode(asked: str | None, default: str = "monitor") -> str:
    """What was asked for, in any case; what is not known gives the default."""
    mode = (asked or "").strip().lower()
    return mode if mode in MODES else default


def joined(context: Column) -> Column:
    return F.array_join(F.transform(context, lambda c: c["text"]), " ")


def diverse(context: Column) -> Column:
    """The passages span three papers or more, and the first three do not agree on one."""
    papers = F.transform(context, lambda c: c["paper"])
    top = F.slice(papers, 1, 3)
    agree = (F.size(top) == 3) & (F.size(F.array_distinct(top)) == 1) & ~F.exists(top, lambda p: p.isNull())
    return (F.size(F.array_distinct(F.filter(papers, lambda p: p.isNotNull()))) >= 3) & ~agree


def ambiguity(query: Column, context: Column, judged: Column | None = None) -> Column:
    """The first reason to ask back, or null: a judge's note, numbers in the other order, an unresolved
    reference, a spread over papers. A signal that cannot be had adds nothing."""
    note = F.lit(None).cast("string") if judged is None else judged
    return F.coalesce(
        note,
        F.when(fx.transposed(query, joined(context)).isNotNull(), "transposition"),
        F.when(fx.unresolved_reference(query), "reference"),
        F.when(diverse(context), "diversity"),
    )


def shared(own: Column, context: Column) -> Column:
    """Share of the tokens ``own`` that some passage of the context has; 0 if there are none."""
    held = F.array_distinct(F.flatten(F.transform(context, lambda c: c["tokens"])))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, held)) / F.size(own))


def sufficient(own: Column, context: Column, judge: Column | None = None) -> Column:
    """No passages: no. Enough of the question's tokens ``own``: yes. Else a judge decides, one that cannot say lets
    the context pass, and without a judge it does not."""
    enough = shared(own, context) >= SUFFICIENT
    return (F.size(context) > 0) & (enough | (F.lit(False) if judge is None else F.coalesce(judge, F.lit(True))))


def attempt(rows: DataFrame, number: int) -> DataFrame:
    """Add ``attempt_<number>`` (from 1) where the question is ``open``: what is made of the passages that its context has.

    ``every`` are the passages with their ``tokens``, ``own`` the question's. Each step is a column of its
    own, so that nothing is computed twice.
    """
    size = min(CONTEXT + (number - 1) * WIDER, MOST_CONTEXT)
    rows = rows.withColumn("context", F.when(F.col("open"), F.slice("every", 1, size)))
    best = F.filter("context", lambda c: F.arrays_overlap(c["tokens"], F.col("own")))
    rows = rows.withColumn("best", F.try_element_at(best, F.lit(1)))
    sentence = F.concat(F.regexp_extract(F.col("best.text"), r"(?s)^(.*?[.!?]|.*)(\s|$)", 1), F.lit(" ["), F.col("best.new_rank").cast("string"), F.lit("]"))
    rows = rows.withColumn("said", F.coalesce(sentence, F.lit(fx.ABSTAIN_TEXT))).withColumn("marks", fx.cited("said"))
    silent = F.col("said").startswith(fx.ABSTAIN_TEXT)
    enough = sufficient(F.col("own"), F.col("context"), F.col("judge") if "judge" in rows.columns else None)
    made = F.struct(
        F.lit(number).alias("number"), F.lit(size).alias("top_n"), enough.alias("sufficient"), "said", silent.alias("abstained"), (silent | (shared(fx.tokens("said"), F.col("context")) >= GROUNDED)).alias("grounded"),
        F.size(F.filter("marks", lambda i: i.between(1, F.size("context")))).alias("valid"), F.size("marks").alias("marks"), ambiguity(F.col("query"), F.col("context")).alias("note"),
    )
    return rows.withColumn(f"attempt_{number}", F.when(F.col("open"), made)).drop("context", "best", "said", "marks")


def answer_questions(questions: DataFrame, ranked: DataFrame, mode: str = "monitor") -> DataFrame:
    """``(qid, text, abstained, n_citations, stripped, sufficient, grounded, note, attempts, generated, saved, outcome, trace)``.

    ``ranked`` holds the reranked passages of each question ``(qid, new_rank, id, text)``, 16 of them if
    there are, and ``paper`` if it is known. Questions of no or too many characters, and those with an
    ``intent`` of ``out_of_scope``, stop at once. A boolean ``judge`` decides on contexts that hold too few of the
    question's tokens, and questions that are ``down`` are those for which no provider gives an answer: they are told so
    and count as failures of the service. Attempts are a fold: the first context has eight passages, the
    next one four more. If a context does not suffice and checks are enforced, an attempt that is not the last makes
    no answer (``saved`` counts these). An answer that abstains or has no grounds in its context is tried
    again; the last attempt answers in any case, and its answer counts. ``trace`` keeps every attempt
    that made one. Citations of passages that are not in the context are stripped; a last answer without
    grounds is declined if checks are enforced.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    enforce = F.lit(mode == "enforce")
    paper = F.col("paper").cast("long") if "paper" in ranked.columns else F.col("id").cast("long")
    item = F.struct(F.col("new_rank").cast("long").alias("new_rank"), F.col("id").cast("long").alias("id"), "text", paper.alias("paper"), fx.tokens("text").alias("tokens"))
    items = ranked.where(F.col("new_rank") <= MOST_CONTEXT).select("qid", item.alias("x"))
    lists = items.groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("every"))
    rows = questions.join(lists, "qid", "left").withColumn("every", F.coalesce("every", F.array().cast(CANDIDATES)))
    fits = F.coalesce(F.length("query").between(1, MOST_CHARS), F.lit(False))
    scope = F.coalesce(F.col("intent") != "out_of_scope", F.lit(True)) if "intent" in questions.columns else F.lit(True)
    rows = rows.withColumns({"fits": fits, "scope": scope, "open": fits & scope, "own": fx.tokens("query")})
    made = []
    for number in range(1, ATTEMPTS + 1):
        # ``open``: an attempt is still to be made. It answers unless a check holds it back and another may follow.
        now = f"attempt_{number}"
        rows = attempt(rows, number)
        held_back = enforce & ~F.col(now)["sufficient"] if number < ATTEMPTS else F.lit(False)
        rows = rows.withColumn(f"skips_{number}", F.coalesce(F.col("open") & held_back, F.lit(False)))
        again = F.col(f"skips_{number}") | F.col(now)["abstained"] | ~F.col(now)["grounded"]
        rows = rows.withColumn("open", F.coalesce(F.col("open") & again, F.lit(False)))
        made.append(F.when(~F.col(f"skips_{number}"), F.col(now)))
    rows = rows.withColumn("trace", F.filter(F.array(*made), lambda a: a.isNotNull())).withColumn("last", F.try_element_at("trace", F.lit(-1)))
    down = F.coalesce(F.col("down"), F.lit(False)) if "down" in questions.columns else F.lit(False)
    outcome = (
        F.when(~F.col("fits"), "too_large")
        .when(~F.col("scope"), "out_of_scope")
        .when(down, "failed")
        .when(enforce & ~F.col("last.grounded"), "ungrounded")
        .when(F.col("last.abstained"), "abstained")
        .otherwise("answered")
    )
    rows = rows.withColumn("outcome", outcome)
    texts = F.create_map(*[F.lit(x) for x in ("too_large", fx.TOO_LARGE_TEXT, "out_of_scope", fx.ABSTAIN_TEXT, "abstained", fx.ABSTAIN_TEXT, "ungrounded", fx.UNGROUNDED_TEXT, "failed", DEGRADED_TEXT)])
    answered = F.col("outcome") == "answered"
    saved = sum((F.col(f"skips_{n}").cast("long") for n in range(1, ATTEMPTS + 1)), F.lit(0).cast("long"))
    return rows.select(
        "qid",
        F.when(answered, F.col("last.said")).otherwise(F.try_element_at(texts, F.col("outcome"))).alias("text"),
        (~answered).alias("abstained"),
        F.when(answered, F.col("last.valid")).otherwise(0).cast("long").alias("n_citations"),
        F.when(answered, F.col("last.marks") - F.col("last.valid")).otherwise(0).cast("long").alias("stripped"),
        F.col("last.sufficient").alias("sufficient"),
        F.col("last.grounded").alias("grounded"),
        F.col("last.note").alias("note"),
        F.coalesce(F.col("last.number"), F.lit(0)).cast("long").alias("attempts"),
        F.size("trace").cast("long").alias("generated"),
        saved.alias("saved"),
        "outcome",
        "trace",
    )


def refusals(outcomes: DataFrame, kind: str = "kind") -> DataFrame:
    """``(kind, n, n_failed, refusal_rate)`` of outcomes by kind and over all (null): failures of the service are a bucket
    of their own, and the rate is over the rest."""
    ran = F.col("outcome") != "failed"
    refused = F.when(ran, F.col("outcome").isin(*REFUSALS).cast("double"))
    return outcomes.rollup(kind).agg(F.count_if(ran).alias("n"), F.count_if(~ran).alias("n_failed"), F.round(F.avg(refused), 6).alias("refusal_rate"))
