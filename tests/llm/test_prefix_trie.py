"""The prefix trie of conversations against brute force, with containers and pieces so small that all paths run."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spindrift.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, head string, n long"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = sum(below[k][0] for k in kids[node]), sum(below[k][1] for k in kids[node])
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (leaves or 1, saved + own_saved)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -(10**9), len(m), len(kids[n]), *below[n], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == n).encode()).hexdigest())
        for n, m in members.items()
    )


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["", "a", "bé", "hello", "x" * 300, None]
    rows = []
    for conv in range(-12, 60):
        if rng.random() < 0.15:
            continue
        common = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = texts[3] if common and turn < 6 else rng.choice(texts)
            rows.append((conv, turn if turn else rng.choice([0, None]), rng.choice(["user", "assistant", None]) if not common else "user", text))
    for conv in range(100, 140):  # copies, with long equal starts
        rows += [(conv, t, "user", "same") for t in range(11)]
    rows += [(200 + 5 * k, t, "user", f"t{t % 7}") for k in range(4) for t in range(23 + k % 2)]
    rows += [rows[3], rows[3], rows[-1], (None, 1, "user", "of no conversation"), (7, 2, "user", "tie b"), (7, 2, "user", "tie a"), (7, 2, "assistant", "tie c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "most", "piece"), [(1, 4096, 512), (3, 1, 4), (4, 5, 1)])
def test_equals_brute_force(spark, seed, most, piece):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(7)
    out = conversation_trie(df, most, piece).collect()
    got = sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in out)
    assert got == brute(rows)


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "", 1)], SCHEMA)).count() == 0


def test_one_long_conversation_among_short_ones(spark):
    rows = [(5, t, "user", f"text {t % 100}") for t in range(3000)] + [(c, 0, "user", "hi") for c in range(10, 40)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    out = conversation_trie(df, 4096, 64).collect()
    got = sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in out)
    assert got == brute(rows)
