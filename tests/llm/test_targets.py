"""Targets of a mix by another way than the operator's: a level found by bisection."""

import random
from collections import Counter

import pytest

from spindrift.llm import mixing
from spindrift.llm.common import words_of


def level_targets(sizes, weights, share, cap):
    """Each source gets the lesser of its limit and its weight times a level; the level that spends all is bisected."""
    low, high, whole = 0.0, cap * sum(sizes) + 1.0, share * sum(sizes)
    for _ in range(200):
        level = (low + high) / 2
        spent = sum(min(cap * s, level * w) for s, w in zip(sizes, weights, strict=True))
        low, high = (level, high) if spent < whole else (low, level)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("seed", range(20))
def test_targets_are_a_level(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 12)
    sizes = [rng.choice([0, 1, 7, 1000, 10**9]) for _ in range(n)]
    weights = [(5, 2, 1)[i % 3] for i in range(n)]
    assert mixing.fill_to_caps(sizes, weights, 1.5, 2.0) == pytest.approx(level_targets(sizes, weights, 1.5, 2.0), rel=1e-9, abs=1e-6)


def test_a_mix_keeps_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["big"] * 6 + ["ä", "b", "Z", None, ""])) for i in range(300)]
    out = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    names = [*sorted(s for s in sizes if s is not None), None]  # by code point, null last
    want = dict(zip(names, level_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) < 3 * 128 for s in names)  # blocks have 128 words, and the last one of a source is shorter


def test_words_of_parts():
    data = b"  alpha\tbeta gamma\n" * 50 + b"x" * 300 + b" end"
    for block in (1, 7, 64, 1 << 22):
        assert [w for some in words_of(data, block) for w in some] == data.split()
