"""Stored indexes: what they answer, and what they read to answer it."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import session
from spindrift.catalog import QUERIES
from spindrift.functions.analysis import ENGLISH, PLAIN, porter
from spindrift.operators import inverted, ivf, positional
from spindrift.operators.dense import cosine_topk
from spindrift.operators.positional import LENGTH, OWN, UNIQUE, positional_topk


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "index")


STEMMED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "formative": "form",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "adoption": "adopt", "communism": "commun", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems_of_the_published_examples():
    assert {w: porter(w) for w in STEMMED} == STEMMED


def test_analysers():
    assert ENGLISH.terms("The dogs' owner's Running, and it is US-based") == [None, "dog", "owner", "run", None, None, None, "us", "base"]
    assert PLAIN.terms("The DOG's 2 é") == ["the", "dog", "s", "2"]
    assert ENGLISH.terms(None) == PLAIN.terms("") == []


def corpus(seed=4, n=600):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        topic = i // 64 * 20 % 280  # neighbours share words, as documents of one source do
        body = [rng.choice(words) if rng.random() < 0.5 else words[topic + rng.randrange(20)] for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(body)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "w1 w1 w1"), (None, "w1 w2")]


def brute_bm25(rows, asked, k, among=None):
    docs = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows if i is not None}
    df = Counter(t for d in docs.values() for t in set(d))
    average = sum(map(len, docs.values())) / len(docs)
    out = []
    for q, text in asked:
        scores = defaultdict(float)
        for t in set(re.findall("[a-z0-9]+", text)) & set(df):
            for i, d in docs.items():
                if tf := d.count(t):
                    scores[i] += math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
        best = sorted(((-round(s, 6), i) for i, s in scores.items() if among is None or i in among))[:k]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    return sorted(out)


ASKED = [(1, "w1 w2 w3"), (2, "w25 w30 nowhere"), (3, "nowhere"), (4, ""), (5, "w1"), (6, " ".join(f"w{i}" for i in range(0, 200, 9)))]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_pruned_search_equals_a_full_one(spark, folder, k):
    rows = corpus()
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(ASKED, "qid long, query string")
    inverted.build_index(docs, folder, buckets=16, range_docs=64)
    index = inverted.open_index(spark, folder)
    got = lambda df: sorted((r.qid, r.id, round(r.score, 5), r["rank"]) for r in df.collect())
    want = lambda found: sorted((q, i, round(s, 5), r) for q, i, s, r in found)
    assert got(inverted.search(index, asked, k)) == want(brute_bm25(rows, ASKED, k))
    some = set(range(0, 600, 7))
    assert got(inverted.search(index, asked, k, spark.createDataFrame([(i,) for i in some], "id long"))) == want(brute_bm25(rows, ASKED, k, some))


def test_a_question_opens_its_terms_files_and_skips_ranges(spark, folder):
    docs = spark.createDataFrame(corpus(n=3000), "doc_id long, text string").coalesce(1)
    index = inverted.build_index(docs, folder, buckets=64, range_docs=64)
    weights = inverted.weighted_terms(index, spark.createDataFrame([(1, "w41 w43 w44 w47")], "qid long, query string"))
    read = inverted.only_asked(index.postings(spark), weights)
    plan = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)
    assert {r[0] for r in read.select("bucket").distinct().collect()} == {r[0] for r in weights.select("bucket").distinct().collect()}
    bounds = inverted.range_bounds(index, weights)
    assert "positions" not in bounds._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    first = sorted((r.bound for r in bounds.collect()), reverse=True)
    tenth = inverted.search(index, spark.createDataFrame([(1, "w41 w43 w44 w47")], "qid long, query string"), 10).agg(F.min("score")).first()[0]
    assert sum(b + 1e-6 >= tenth for b in first) < 0.7 * len(first)  # ranges that have to be read


def test_best_field(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple", "pear pear plum"), (2, "pear", "apple"), (3, "plum", "plum plum apple")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "pear plum")], "qid long, query string")
    fields = [(inverted.build_index(docs, str(tmp_path / name), text=name), weight) for name, weight in (("text", 1.0), ("title", 2.0))]
    single = {(r.qid, r.id): r.score for r in inverted.search(fields[0][0], asked, 9).collect()}
    title = {(r.qid, r.id): 2 * r.score for r in inverted.search(fields[1][0], asked, 9).collect()}
    best = {(r.qid, r.id): r.score for r in inverted.search_fields(fields, asked, 9).collect()}
    assert best == pytest.approx({key: max(single.get(key, 0), title.get(key, 0)) for key in single | title}, abs=2e-6)


def test_positional_rank_by_hand(spark, folder):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red and the quick fox"), (3, "fox"), (4, "fox fox red fox"), (5, None)], "doc_id long, text string")
    index = inverted.build_index(docs, folder, analyser=ENGLISH)
    asked = spark.createDataFrame([(1, "the red foxes"), (2, "fox"), (3, "red wolf"), (4, "the")], "qid long, query string")
    near = lambda d: 0.1 / math.sqrt(1.005 + 0.05 * math.exp(d / 1.5 - 2))
    found = {(r.qid, r.id): r.score for r in positional_topk(index, asked, 9).collect()}
    once = 0.1 / (math.pi**2 / 6)
    want = {(1, 1): near(1), (1, 2): near(4), (1, 4): 1 - (1 - near(2)) * (1 - near(1)) ** 2, (2, 1): once, (2, 2): once, (2, 3): once, (2, 4): once * (1 + 1 / 4 + 1 / 9)}
    assert found == pytest.approx(want, abs=1e-6)
    scaled = {(r.qid, r.id): r.score for r in positional_topk(index, asked, 9, norm=LENGTH | OWN).collect()}
    assert scaled[1, 4] == pytest.approx(want[1, 4] / 4 / (want[1, 4] / 4 + 1), abs=1e-6)


@pytest.mark.parametrize("pairs", [1, 1_000_000])
def test_a_positional_scan_equals_the_index(spark, folder, monkeypatch, pairs):
    monkeypatch.setattr(positional, "BLOCK_PAIRS", pairs)
    rows = [*corpus(), (700, "the W1's w2 w2 and w1"), (701, "w7 w7 w7"), (702, "the"), (703, "w2 " + "the " * 200 + "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([*ASKED, (7, "the"), (8, None), (9, "W2 the w1's"), (10, "w7"), (11, "w41 w43"), (None, "w1")], "qid long, query string")
    index = inverted.build_index(docs, folder, analyser=ENGLISH, range_docs=64)
    ranks = lambda df: sorted(tuple(r) for r in df.collect())
    for norm in (0, LENGTH | UNIQUE | OWN):
        got = ranks(positional.positional_scan(docs, asked, 7, ENGLISH, norm=norm))
        assert got == ranks(positional_topk(index, asked, 7, norm=norm)) and {1, 5, 9, 10, 11} <= {r[0] for r in got}
    assert positional.positional_scan(docs, asked.where("qid = 8"), 7, ENGLISH).count() == 0


def test_a_positional_query_writes_less_than_it_reads(spark):
    before = len(session.WRITTEN)
    assert QUERIES["lexical_ts_rank"](spark, "/root/testdata/sf0.001").count() > 0
    written = sum(f.stat().st_size for folder in session.WRITTEN[before:] for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())
    assert written < Path("/root/testdata/sf0.001/documents.parquet").stat().st_size


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 32))
    rows = [(i, (middles[i % 40] + 0.35 * rng.normal(size=32)).tolist()) for i in range(4000)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()


def test_vectors_in_cells(spark, folder, points):
    ivf.build_vectors(points, folder, cells=40)
    index = ivf.open_vectors(spark, folder)
    assert index.rows(spark).count() == 4000 and index.codes(spark).agg(F.sum(F.size("ids"))).first()[0] == 4000
    asked = points.where("vec_id % 80 = 0 or vec_id > 5000").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    want = {(r.qid, r.id): r.score for r in cosine_topk(points, asked.where("qid <= 4000"), 10).collect()}
    few = ivf.probe(index, asked, 10, 2)
    plan = few._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*cell", plan)
    got = {(r.qid, r.id): r.score for r in ivf.search_vectors(index, asked, 10).collect()}
    assert {q for q, _ in got} == {q for q, _ in want}  # vectors that cannot be compared find nothing
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(s == pytest.approx(want[key], abs=2e-6) for key, s in got.items() if key in want)


def test_no_vectors(spark, folder, points):
    with pytest.raises(ValueError, match="no vector"):
        ivf.build_vectors(points.where("vec_id > 4999"), folder)
    index = ivf.build_vectors(points.where("vec_id < 3"), folder)
    assert ivf.search_vectors(index, points.where("vec_id = 1").selectExpr("vec_id as qid", "embedding as vector"), 10).count() == 3
    assert ivf.probe(index, points.where("vec_id = 5000").selectExpr("vec_id as qid", "embedding as vector"), 10, 1).count() == 0


def test_backends_give_the_lists_of_a_scan(spark, tmp_path):
    from spindrift.plans.hybrid import Backend, arms

    docs = spark.createDataFrame(corpus(n=100), "doc_id long, text string").where("doc_id is not null")
    asked = spark.createDataFrame(ASKED, "qid long, query string")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(100)], "vec_id long, embedding array<double>")
    own = vectors.where("vec_id between 1 and 6").selectExpr("vec_id as qid", "embedding as vector")
    index = inverted.build_index(docs, str(tmp_path / "terms"))
    backend = Backend(((index, 1.0),), ivf.build_vectors(vectors, str(tmp_path / "cells"), cells=1))
    want = {tuple(r) for r in arms(docs, vectors, asked, own, 9).collect()}
    assert {tuple(r) for r in arms(docs, vectors, asked, own, 9, backend=backend).collect()} == want
    some = docs.where("doc_id % 2 = 0").select("doc_id")
    assert {tuple(r) for r in arms(docs, vectors, asked, own, 9, some, backend=backend).collect()} == {tuple(r) for r in arms(docs, vectors, asked, own, 9, some).collect()}
    every = Backend(((inverted.build_index(docs, str(tmp_path / "stems"), analyser=ENGLISH), 1.0),), every_term=True)
    assert {r.id for r in every.lexical(asked.where("qid = 5"), 200).collect()} == {i for i, t in corpus(n=100) if t and i is not None and "w1" in t.split()}
