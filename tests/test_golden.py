"""Golden cases of single operators."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import text as fx
from spindrift.functions.embedding import hash_embed
from spindrift.operators import chunking, fusion, metrics, temporal
from spindrift.sources import parsers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def ranked(spark, lists):
    return spark.createDataFrame([(1, n, r, i) for n, ids in enumerate(lists) for r, i in enumerate(ids, 1)], "qid int, list_no int, rank int, id string")


def test_fusion(spark):
    got = {r["id"]: (r["score"], r["rank"]) for r in fusion.fuse(ranked(spark, [["a", "b"], ["a", "d", "b"]])).collect()}
    assert got == {"a": (round(2 / 61, 9), 1), "b": (round(1 / 62 + 1 / 63, 9), 2), "d": (round(1 / 62, 9), 3)}
    assert fusion.fuse(ranked(spark, [[], []])).collect() == []


def test_fusion_ties_keep_the_first_seen(spark):
    assert [r["id"] for r in fusion.fuse(ranked(spark, [["z", "a"], ["y", "b"]])).orderBy("rank").collect()] == ["z", "y", "a", "b"]


def judged(spark, grades):
    return spark.createDataFrame([(1, i, g) for i, g in grades.items()], "qid int, id string, grade int")


def ranks(spark, ids):
    return spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "qid int, id string, rank int")


def test_metrics(spark):
    j = judged(spark, {"a": 1, "b": 1, "z": 0})
    assert metrics.recall(ranks(spark, ["a", "b", "c"]), j, 3).first()["recall"] == pytest.approx(2 / 3)
    assert metrics.reciprocal_rank(ranks(spark, ["x", "y", "a"]), j, 3).first()["mrr"] == pytest.approx(1 / 3)
    assert metrics.reciprocal_rank(ranks(spark, ["x", "y", "a"]), j, 2).first()["mrr"] == 0
    only = judged(spark, {"a": 1})
    assert metrics.ndcg(ranks(spark, ["x", "a"]), only, 10).first()["ndcg"] == pytest.approx(1 / 1.584962500721156)
    assert metrics.ndcg(ranks(spark, ["a"]), judged(spark, {"a": 0}), 10).first()["ndcg"] == 0


def test_floor_percentiles(spark):
    rows = spark.range(1, 101).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    assert metrics.floor_percentiles(rows, "g", "v", {"p": 0.95, "q": 1.0}).first()[1:] == (96, 100)


def reference_windows(text, size, overlap):
    out, start = [], 0
    while text:
        out.append((start, min(start + size, len(text))))
        if out[-1][1] == len(text):
            break
        start += size - overlap
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6000), min_size=1, max_size=20), st.sampled_from([0, 200]))
def test_windows_equal_the_loop(spark, lengths, overlap):
    sections = spark.createDataFrame([(str(i), 0, None, "x" * n) for i, n in enumerate(lengths)], "paper_id string, section_no int, heading string, text string")
    got = {(r["paper_id"], r["char_start"], r["char_end"]) for r in chunking.fixed_windows(sections, 1600, overlap).collect()}
    assert got == {(str(i), a, b) for i, n in enumerate(lengths) for a, b in reference_windows("x" * n, 1600, overlap)}


def test_windows_reject_an_overlap_that_never_ends(spark):
    with pytest.raises(ValueError):
        chunking.windows(F.lit("x"), 100, 100)


def sections(spark, *texts):
    return spark.createDataFrame([("p", i, None, t) for i, t in enumerate(texts)], "paper_id string, section_no int, heading string, text string")


def test_offsets_count_over_sections(spark):
    got = sorted((r["char_start"], r["char_end"]) for r in chunking.fixed_windows(sections(spark, "12345", "67890")).collect())
    assert got == [(0, 5), (5, 10)]


def test_content_ids(spark):
    a, b = one(spark, fx.content_id("p", F.col("t")), p="1", t="same"), one(spark, fx.content_id("p", F.col("t")), p="2", t="same")
    assert a != b and len(a) == 64


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60))
def test_recursive_spans_are_in_order_and_fit(text, size):
    spans = list(chunking.split_at(text, ("\n\n", "\n", ". "), size))
    assert all(0 <= a <= b <= len(text) and b - a <= size for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered or c in ". \n" for i, c in enumerate(text))


def test_short_lines_merge(spark):
    text = "\n".join(["a short line of text"] * 100)
    assert chunking.recursive_separator(sections(spark, text)).count() < 10
    assert chunking.recursive_separator(sections(spark, "   ")).count() == 0


def test_sentences_that_differ_part():
    import numpy as np

    v = np.array([[1, 0], [0.99, 0.01], [0, 1]])
    got = chunking.break_sentences("One here. Two here. Three.", lambda s: v[: len(s)], 0.35, 1600)
    assert got == [("One here. Two here.", 0, 19), ("Three.", 20, 26)]


def test_the_last_copy_of_a_passage_stays(spark):
    rows = spark.createDataFrame([("c", 0, "old"), ("d", 1, "x"), ("c", 2, "new")], "chunk_id string, no int, v string")
    got = {(r["chunk_id"], r["place"]["no"], r["v"]) for r in chunking.dedup_by_id(rows, ["no"]).collect()}
    assert got == {("c", 0, "new"), ("d", 1, "x")}


def test_markdown(spark):
    files = spark.createDataFrame([("p", "lead\n\n# Title\nintro\n#nothash\n## Sub \nmore\n# Empty\n")], "paper_id string, text string")
    got = [(r["section_no"], r["heading"], r["text"]) for r in parsers.parse_markdown(files).orderBy("section_no").collect()]
    assert got == [(0, None, "lead"), (1, "Title", "intro\n#nothash"), (2, "Sub", "more")]


def test_html():
    html = "<html><script>x()</script><h1>Over<b>view</b></h1><p>Hello <b>world</b></p><h2>Details</h2><ul><li><p>in</p></li></ul><h3>None</h3></html>"
    assert parsers.html_sections(html) == [{"heading": "Overview", "text": "Helloworld"}, {"heading": "Details", "text": "in\nin"}]


def test_docx():
    from spindrift.catalog.evidence import docx_of

    assert parsers.docx_sections(docx_of("Head\none\n\ntwo & three")) == [{"heading": "Head", "text": "one\ntwo & three"}]


def test_parser_names(spark):
    got = {n: one(spark, parsers.parser_name(F.col("n")), n=n) for n in ("NOTES.TXT", "a.zip", "x.tar.md", "none")}
    assert got == {"NOTES.TXT": "txt", "a.zip": None, "x.tar.md": "markdown", "none": None}


def test_layout(spark):
    lines = [(1, 0, 1, "A Heading", 14.0), (1, 1, 1, "body text.", 10.0), (1, 2, 2, "more", 10.0), (1, 3, 2, "Ends with a dot.", 14.0), (1, 4, 3, "Next", 12.0), (1, 5, 3, "tail", 10.0)]
    frame = spark.createDataFrame(lines, "paper_id int, pos int, page int, line string, size double")
    got = [(r["heading"], r["text"], r["page"]) for r in parsers.layout_sections(frame).orderBy("section_no").collect()]
    assert got == [("A Heading", "body text. more Ends with a dot.", 1), ("Next", "tail", 3)]


def test_atom(spark):
    xml = "<entry><id>http://h/abs/2301.12345v2</id><title> A\n  b </title><summary>s</summary><author><name> N M </name></author><category term='cs.CL'/><published>2023-01-30T18:00:00Z</published><link title='pdf' href='http://h/p'/></entry>"
    cols = parsers.atom_entry(F.col("x"))
    got = spark.createDataFrame([(xml,)], "x string").select(*[c.alias(n) for n, c in cols.items()]).first()
    assert tuple(got) == ("2301.12345", "A b", "s", "N M", "cs.CL", datetime.date(2023, 1, 30), "http://h/p")


def test_rewrite_is_skipped_only_for_specific_questions(spark):
    skip = lambda q: one(spark, fx.skip_rewrite("q"), q=q)
    assert skip("What method does the tool use to build its index?")
    assert not skip("What method?")
    assert not skip("How does the RLHF method train such a large model here")
    assert not skip("How do I bake bread with wild yeast at home")


def test_numbers(spark):
    got = lambda q, c: one(spark, fx.transposed(F.col("q"), F.col("c")), q=q, c=c)
    hit = got("900 states from 3,009 questions", "There are 3009 states from 900 questions")
    assert (hit["a"], hit["b"]) == (900, 3009)
    assert got("900 states from 3,009 questions", "900 and 3009, or 3009 and 900") is None
    assert got("900 states", "900 3009") is None
    assert one(spark, fx.numbers("q"), q="1,234.9 and 7.") == [1234, 7]


def test_unresolved_references(spark):
    flagged = lambda q: one(spark, fx.unresolved_reference(F.col("q")), q=q)
    assert flagged("What score did the framework reach?") and flagged("How does it work?")
    assert not flagged("What does GEM say of the model?") and not flagged("Is the model in 2301.12345 large?")
    assert not flagged("What is item management?") and flagged("Does the model help management?")


def test_citations(spark):
    cited = lambda t: one(spark, fx.cited(fx.plain_brackets(F.col("t"))), t=t)
    assert cited("a [1] b 【2】 c [3†L1-L4] [1]") == [1, 2, 3]
    assert cited("[unclear] none") == []


def test_declines(spark):
    rows = [("It is so [1].", True, False, False, 1, False), ("Which one?", True, False, False, 1, True), ("No cites.", True, False, False, 0, True), ("Which one?", False, False, False, 1, False), ("The premise here is wrong [1].", True, False, False, 1, True), ("The passages do not report it [1].", True, False, False, 1, True), ("x", True, True, False, 0, False)]
    frame = spark.createDataFrame(rows, "t string, note boolean, abstained boolean, tagged boolean, n int, want boolean")
    got = frame.select(fx.declined(F.col("t"), F.col("note"), F.col("abstained"), F.col("tagged"), F.col("n")).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_overlap(spark):
    assert one(spark, fx.overlap("a", "b"), a="The cat sat here", b="cat here") == pytest.approx(2 / 3)
    assert one(spark, fx.overlap("a", "b"), a="the of", b="cat") == 0


def test_rate_limit(spark):
    calls = spark.createDataFrame([(c, t) for c in "ab" for t in range(11)], "who string, t long")
    got = temporal.admit(calls, "who", F.col("t"), ["t"], 10, 60).groupBy("who").agg(F.count_if("admitted").alias("n")).collect()
    assert {r["who"]: r["n"] for r in got} == {"a": 10, "b": 10}


def test_cache_entries_live_from_the_miss_on(spark):
    events = [("k", 0, 0, True), ("k", 5, 1, True), ("k", 10, 2, True), ("k", 12, 3, True), ("e", 0, 4, False), ("e", 1, 5, True), ("e", 2, 6, False)]
    frame = spark.createDataFrame(events, "key string, seconds long, event_id long, cacheable boolean")
    got = {r["event_id"]: r["hit"] for r in temporal.cache_hits(frame, 10).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_embeddings_are_unit_or_zero():
    v = hash_embed(["a b c", ""])
    assert (v[0] ** 2).sum() == pytest.approx(1) and not v[1].any()


def test_vector_search_passes_over_bad_vectors(spark):
    from spindrift.operators.dense import cosine_topk

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [-1.0, 0.0]), (9, [0.6, 0.8])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0]), (2, None), (3, [float("inf"), 1.0])], "qid long, vector array<double>")
    got = [tuple(r) for r in cosine_topk(docs, asked, 3).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 1.0, 1), (0, 2, 1.0, 2), (0, 9, 0.6, 3), (1, 5, 1.0, 1)]
    assert cosine_topk(docs, asked.where("qid = 2"), 3).count() == 0


def test_bm25_in_tasks_equals_the_joined_form(spark, monkeypatch):
    from spindrift.operators import lexical
    from spindrift.operators.ranking import top_k

    texts = ["Red fish, blue fish", "one fish", "", None, "the red house and the blue house", "house", "zzz"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "red FISH"), (2, "house"), (3, "nothing"), (4, "the blue fish")], "qid long, query string")
    want = sorted(map(tuple, top_k(lexical.bm25_scores(docs.where("text is not null"), asked, "doc_id", F.col("text")), 4).collect()))
    assert sorted(map(tuple, lexical.bm25_topk(docs.where("text is not null"), asked, 4, "doc_id", F.col("text")).collect())) == want
    monkeypatch.setattr(lexical, "BLOCK_QUESTIONS", 1)
    assert sorted(map(tuple, lexical.bm25_topk(docs.where("text is not null"), asked, 4, "doc_id", F.col("text")).collect())) == want
    some = docs.where("doc_id % 2 = 0").select("doc_id")
    assert {r["id"] % 2 for r in lexical.bm25_topk(docs, asked, 4, "doc_id", F.col("text"), eligible=some).collect()} == {0}


def test_filters_hold_together(spark):
    from spindrift.operators.filters import Filters, author_contains, condition, sanitised

    rows = [("1", ["Ann Lee"], ["en"], "2024-02-01", None), ("2", ["Bo"], ["en"], "2024-03-01", "s1"), ("3", ["Ann"], ["fr"], "2024-03-02", "s2"), ("4", ["Annette"], ["en"], None, None)]
    papers = spark.createDataFrame(rows, "paper_id string, authors array<string>, category array<string>, d string, owner string").withColumn("published_date", F.to_date("d"))
    ids = lambda f, **k: sorted(r[0] for r in papers.where(condition(f, **k)).select("paper_id").collect())
    assert ids(Filters()) == ["1", "4"] and ids(Filters(session="s1")) == ["1", "2", "4"]
    assert ids(Filters(author="ann")) == ["1"] and ids(Filters(author="ann"), author=author_contains) == ["1", "4"]
    assert ids(Filters(category="en", date_from="2024-02-15", session="s1")) == ["2"] and ids(Filters(document="3", session="s2")) == ["3"]
    assert sanitised(Filters(category="fr", author="x"), papers) == Filters(author="x") and sanitised(Filters(category="en"), papers).category == "en"


def test_answers_of_a_batch(spark):
    from spindrift.functions import text as fx
    from spindrift.plans.answers import answer_questions, guardrail_mode

    filler = [(0, n, n, f"filler number text{n} only.") for n in range(1, 9)]
    late = [*filler, (0, 9, 9, "Tungsten melts extremely late. More.")]
    ranked = spark.createDataFrame([*late, *[(1, n, 5, "Graphite conducts heat well. And so on.") for n in range(1, 4)]], "qid long, new_rank long, id long, text string")
    asked = spark.createDataFrame([(0, "tungsten melts extremely late", "factual"), (1, "graphite conducts heat", "factual"), (2, "x" * 2001, "factual"), (3, "", "factual"), (4, "any words", "out_of_scope"), (5, "nothing found here", "factual")], "qid long, query string, intent string")
    for mode in ("monitor", "enforce"):
        got = {r["qid"]: r for r in answer_questions(asked, ranked, mode).collect()}
        assert [got[q]["outcome"] for q in (1, 2, 3, 4)] == ["answered", "too_large", "too_large", "out_of_scope"]
        assert got[1]["text"] == "Graphite conducts heat well. [1]" and got[1]["n_citations"] == 1 and got[1]["note"] is None and got[1]["attempts"] == 1
        assert got[2]["text"] == fx.TOO_LARGE_TEXT and got[4]["text"] == fx.ABSTAIN_TEXT and got[2]["attempts"] == 0 and got[2]["trace"] == []
        # The first context holds nothing: it is held back, or its answer abstains, and the wider one answers.
        assert got[0]["outcome"] == "answered" and got[0]["attempts"] == 2 and got[0]["note"] == "diversity"
        assert (got[0]["generated"], got[0]["saved"]) == ((1, 1) if mode == "enforce" else (2, 0))
        assert [a["abstained"] for a in got[0]["trace"]] == ([False] if mode == "enforce" else [True, False])
        # Nothing at all: the last attempt answers although its context does not suffice.
        assert got[5]["outcome"] == "abstained" and got[5]["attempts"] == 2 and got[5]["sufficient"] is False
    assert [guardrail_mode(x) for x in (None, "ENFORCE", "what")] == ["monitor", "enforce", "monitor"]


def test_ambiguity_has_an_order(spark):
    from spindrift.plans.answers import ambiguity

    candidates = "array<struct<new_rank:bigint,id:bigint,text:string,paper:bigint>>"
    spread = [(i, i, f"In 7 parts, {i} things, 30 states from 500 questions", i) for i in range(1, 5)]
    cases = [("Are there 500 states from 30 questions? it", spread, "transposition"), ("what does it do", spread, "reference"), ("what is the GEM", spread, "diversity"), ("what is the GEM", spread[:2], None)]
    frame = spark.createDataFrame([(i, q, c) for i, (q, c, _) in enumerate(cases)], f"i int, query string, context {candidates}")
    got = [r["n"] for r in frame.select("i", ambiguity(F.col("query"), F.col("context")).alias("n")).orderBy("i").collect()]
    assert got == [n for _, _, n in cases]
    judged = frame.select(ambiguity(F.col("query"), F.col("context"), F.lit("judge")).alias("n")).first()["n"]
    assert judged == "judge"
