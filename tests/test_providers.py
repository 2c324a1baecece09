"""Ladders of providers, configurations that fail, and files of any kind."""

import pytest

from spindrift.catalog.providers import packed_docx
from spindrift.operators.evaluation import Configuration, evaluate
from spindrift.functions.embedding import hash_embed
from spindrift.operators import chunking
from spindrift.plans.answers import answer_questions, refusals
from spindrift.plans.planner import instructions, parse_plan, plan_questions, variants
from spindrift.plans.providers import REGISTRY, Registry, embed_ladder, question_share, rerank_ladder, role_ladders
from spindrift.sources.dispatch import parse_files, scan_files


def fails(query, texts):
    raise TimeoutError("no answer")


@pytest.fixture(scope="module")
def held(spark):
    rows = [(q, f"red fox {q}", i, i, t) for q in (1, 2) for i, t in enumerate(["blue", "a red fox", "fox", None, "red fox red"], 1)]
    return spark.createDataFrame(rows, "qid long, query string, id long, rank long, text string")


def ladder(held, *rungs):
    return {(r.qid, r.new_rank): (r.id, r.rerank_score, r.served, r.reason) for r in rerank_ladder(held, list(rungs), 3).collect()}


def test_the_first_rung_that_works_serves(held):
    good = ladder(held, ("one", question_share))
    assert [good[1, n][:3] for n in (1, 2, 3)] == [(2, 1.0, "one"), (5, 1.0, "one"), (3, 0.5, "one")]
    after = ladder(held, ("down", fails), ("one", question_share))
    assert {k: v[:3] for k, v in after.items()} == {k: v[:3] for k, v in good.items()}
    assert after[1, 1][3] == "down: TimeoutError: no answer"


@pytest.mark.parametrize("scorer", [fails, lambda q, t: [1.0], lambda q, t: [float("nan")] * len(t), lambda q, t: None])
def test_without_a_rung_the_list_stays(held, scorer):
    left = ladder(held, ("bad", scorer))
    assert [left[2, n][:3] for n in (1, 2, 3)] == [(1, None, None), (2, None, None), (3, None, None)]
    assert left[2, 1][3].startswith("bad: ")


def test_a_row_falls_back_alone(held):
    only_one = lambda q, t: question_share(q, t) if q.endswith("1") else fails(q, t)
    out = ladder(held, ("some", only_one), ("rest", lambda q, t: [float(len(x)) for x in t]))
    assert out[1, 1][2] == "some" and out[2, 1][:3] == (5, 11.0, "rest")


def test_registry():
    own = Registry()
    own.register("a", fails, "rerank", "judge")
    own.register("b", question_share, "rerank")
    assert [n for n, _ in own.ladder("rerank")] == ["a", "b"] and [n for n, _ in own.ladder("rerank", "b")] == ["b"]
    for error, ask in ((KeyError, lambda: own.ladder("none")), (ValueError, lambda: own.ladder("rerank", "c")), (ValueError, lambda: own.register("a", fails))):
        with pytest.raises(error):
            ask()
    assert [n for n, _ in REGISTRY.ladder("rerank")] == ["question_share", "hashed_cosine"]


def test_an_override_is_the_whole_ladder(spark):
    bindings = spark.createDataFrame([("x", 5, "p"), ("x", 9, "q"), ("y", 1, "r")], "role string, rung int, provider string")
    overrides = spark.createDataFrame([("x", "o"), ("y", ""), ("z", "w")], "role string, provider string")
    assert sorted(map(tuple, role_ladders(bindings, overrides).collect())) == [("x", 1, "o"), ("y", 1, "r")]


def test_failures_are_misses_and_a_bucket(spark):
    judged = spark.createDataFrame([(q, 1, 1) for q in range(4)], "qid long, id long, grade int")
    ranked = spark.createDataFrame([(q, 1, 1) for q in range(3)], "qid long, id long, rank long")
    errors = lambda ids: spark.createDataFrame([(q, "broken") for q in ids], "qid long, error string")
    out = {r.config: r for r in evaluate([Configuration("some", "x", ranked, errors([2])), Configuration("all", "x", ranked, errors(range(4))), Configuration("none", "x", ranked), Configuration("off", "key", reason="no key")], judged).collect()}
    assert (out["some"].status, out["some"].n_failed, out["some"].recall, round(out["some"].recall_answered, 4)) == ("ran", 1, 0.5, 0.6667)
    assert (out["all"].status, out["all"].reason, out["all"].recall) == ("error", "broken", None)
    assert (out["none"].status, out["none"].recall, out["none"].n_failed) == ("ran", 0.75, 0)
    assert (out["off"].status, out["off"].reason, out["off"].mrr, out["off"].needs) == ("not run", "no key", None, "key")


def test_files_go_to_their_parsers(spark, tmp_path):
    files = {
        "a.txt": b" plain \xff ", "b.md": b"lead\n# One\ntext\n\n## Two\n### Three\nmore", "c.HTML": b"<h2>Head</h2><p>x &amp; y</p><li>z</li>",
        "d.docx": packed_docx(["Head", "line <1>", "", "line 2"]), "e.docx": b"no archive", "f.pdf": b"%PDF", "g": b"x", "h.txt": b" \n", "sub/i.txt": b"deep",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    out = parse_files(scan_files(spark, str(tmp_path)))
    got = {}
    for r in out.orderBy("path", "section_no").collect():
        got.setdefault(r.path.split(tmp_path.name + "/")[1], []).append((r.parser, r.status, r.heading, r.text))
    assert got == {
        "a.txt": [("txt", "parsed", None, "plain �")], "b.md": [("markdown", "parsed", None, "lead"), ("markdown", "parsed", "One", "text"), ("markdown", "parsed", "Three", "more")],
        "c.HTML": [("html", "parsed", "Head", "x & y\nz")], "d.docx": [("docx", "parsed", "Head", "line <1>\nline 2")], "e.docx": [("docx", "error: BadZipFile", None, None)],
        "f.pdf": [("pdf", "unsupported", None, None)], "g": [(None, "unsupported", None, None)], "h.txt": [("txt", "empty", None, None)], "sub/i.txt": [("txt", "parsed", None, "deep")],
    }
    none = spark.createDataFrame([(None, None), ("x.txt", None)], "path string, content binary")
    assert sorted((r.status for r in parse_files(none).collect())) == ["empty", "unsupported"]


def test_embeddings_fall_back_text_by_text(spark):
    def picky(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return hash_embed(texts, 8)

    rows = [(1, "good"), (2, "bad"), (3, None), (4, "good"), (None, "bad")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    out = {r.id: (len(r.vector), r.provider) for r in embed_ladder(df, [("picky", picky), ("rest", lambda t: hash_embed(t, 4))], "id").collect()}
    assert out == {1: (8, "picky"), 2: (4, "rest"), 3: (8, "picky"), 4: (8, "picky"), None: (4, "rest")}
    none = embed_ladder(df, [("short", lambda t: hash_embed(t)[1:]), ("nan", lambda t: [[float("nan")]] * len(t))], "id").collect()
    assert len(none) == 5 and all(r.vector is None and r.provider is None and r.reason.startswith("short: ") for r in none)
    assert embed_ladder(df.limit(0), [("picky", picky)], "id").count() == 0


def test_judges_and_failures_of_the_service(spark):
    ranked = spark.createDataFrame([(q, n, n, f"Iron rusts slowly {n}. More.") for q in range(4) for n in range(1, 4)], "qid long, new_rank long, id long, text string")
    rows = [(0, "iron tungsten graphite basalt quartz", True, False), (1, "iron tungsten graphite basalt quartz", False, False), (2, "iron tungsten graphite basalt quartz", None, False), (3, "iron rusts slowly", None, True)]
    asked = spark.createDataFrame(rows, "qid long, query string, judge boolean, down boolean")
    out = {r.qid: r for r in answer_questions(asked, ranked, "enforce").collect()}
    assert [out[q].sufficient for q in range(3)] == [True, False, True] and [out[q].saved for q in range(3)] == [0, 1, 0]
    assert [out[q].outcome for q in range(4)] == ["answered", "answered", "answered", "failed"]
    outcomes = spark.createDataFrame([("a", "answered"), ("a", "abstained"), ("a", "failed"), ("b", "failed")], "kind string, outcome string")
    assert {tuple(r) for r in refusals(outcomes).collect()} == {("a", 2, 1, 0.5), ("b", 0, 1, None), (None, 2, 2, 0.5)}


def test_chunkers_are_registered_once(monkeypatch):
    monkeypatch.setattr(chunking, "REGISTERED", dict(chunking.REGISTERED))
    chunking.register("own", lambda embed: lambda s: s)
    assert "own" in chunking.strategies(hash_embed) and len(chunking.strategies(hash_embed)) == 6
    with pytest.raises(ValueError, match="registered already"):
        chunking.register("semantic", lambda embed: lambda s: s)


GOOD = '{"normalized": "n", "expansions": ["a", "n"], "filters": {"author": "x", "date_from": "2024-01-02"}, "intent": "multi_hop"}'


@pytest.mark.parametrize(
    "raw",
    ["", None, "[]", "{}", GOOD.replace("multi_hop", "other"), GOOD.replace('"n",', "1,", 1), GOOD.replace('["a", "n"]', '"a"'), GOOD.replace('"x"', "3"), GOOD.replace("2024-01-02", "soon"), GOOD.replace('{"author": "x", "date_from": "2024-01-02"}', "[1]")],
)
def test_plans_that_cannot_be_read(raw):
    with pytest.raises(ValueError):
        parse_plan(raw)


def test_plans(spark):
    def second(told, query):
        if query == "twice":
            raise TimeoutError("no")
        assert "de, en" in told
        return GOOD

    first = lambda told, query: "{" if query != "whole" else GOOD
    long = "which method of these is the best one for tables"
    asked = spark.createDataFrame([(1, "whole"), (2, "second"), (3, "twice"), (4, long), (5, None), (6, "whole")], "qid long, query string")
    out = {r.qid: r for r in plan_questions(asked, [("first", first), ("second", second)], ["en", "de"]).collect()}
    assert [out[q].served for q in range(1, 7)] == ["first", "second", None, None, "second", "first"]
    assert out[1].author == "x" and out[1].date_from == "2024-01-02" and out[1].category is None and not out[1].degraded
    assert (out[3].degraded, out[3].normalized, out[3].reason) == (True, "twice", "second: TimeoutError: no")
    assert (out[4].skipped, out[4].degraded, out[4].normalized) == (True, False, long)
    assert plan_questions(asked, [], always=True).where("degraded and reason = 'no planner'").count() == 6
    every = {(r.qid, r.variant_no): r["query"] for r in variants(plan_questions(asked.where("qid = 1"), [("first", first)])).collect()}
    assert every == {(1, 0): "n", (1, 1): "a"} and "category has" not in instructions()
