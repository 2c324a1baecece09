"""The pipeline's stages, each against brute force on what the one before kept."""

import hashlib
from collections import Counter

import corpus_pipeline
from spindrift.llm import bpe
from tests.llm.test_operators import SCHEMA, SF, brute_lines, components, ordered, some_texts, texts_of


def sets_of(text):
    t = tuple((text or "").lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)} or ({t} if t else set())


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", "ab"[i % 2], 1, "x", 1, 2, 3) for i, t in enumerate(some_texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    assert ordered(texts_of(known)) == ordered((i, t) for i, t in texts_of(docs) if any(c.isalpha() for c in t or ""))
    lines = stages["line_dedup"](spark, known, SF)
    assert lines.columns == docs.columns
    assert ordered(texts_of(lines)) == ordered((i, t) for i, t, _, _ in brute_lines(texts_of(known)))
    held = texts_of(lines)
    sets = [sets_of(t) for _, t in held]
    part = components(len(held), [(a, b) for a in range(len(held)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    least = {}
    for (i, _), p in zip(held, part, strict=True):
        least[p] = min(i, least.get(p, i))
    once = stages["simhash_near_dedup"](spark, lines, SF)
    assert once.columns == docs.columns
    assert ordered(texts_of(once)) == ordered(x for x, p in zip(held, part, strict=True) if x[0] == least[p])
    mixed = stages["mixing"](spark, once, SF)
    assert mixed.columns == docs.columns
    whole = dict(texts_of(once))
    assert all(set(t.split()) <= set(whole[i].split()) for i, t in texts_of(mixed))
    assert max(Counter(i for i, _ in texts_of(mixed)).values()) <= 2
    encoded = stages["bpe"](spark, mixed, SF)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert ordered((r["doc_id"], r["decoded_sha256"]) for r in encoded.collect()) == ordered((i, sha(t)) for i, t in texts_of(mixed))


def test_stages_with_nulls_and_repeated_ids(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "a", None, None, None, None, None) for i, t in enumerate(some_texts())]
    rows += [rows[3], rows[3], (3, "another text under the same id", "fr", "b", None, None, None, None, None), (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert known.where("lang is null").isEmpty() and known.where("doc_id is null").count() == 1 and known.where("doc_id = 3").count() == 4
    lines = stages["line_dedup"](spark, known, SF)
    assert lines.count() == known.count()
    once = [stages["simhash_near_dedup"](spark, lines.repartition(n), SF) for n in (2, 5)]
    assert ordered(map(tuple, once[0].collect())) == ordered(map(tuple, once[1].collect()))
    ids = [r["doc_id"] for r in once[0].collect()]
    assert ids.count(3) == 1 and ids.count(None) == 1
    mixed = stages["mixing"](spark, once[0], SF)
    assert mixed.columns == docs.columns and stages["bpe"](spark, mixed, SF).count() == mixed.count() > 0


def test_run_on_a_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 500 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    assert bpe.vocabulary_path()


def test_empty_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
