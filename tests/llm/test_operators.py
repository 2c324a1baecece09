"""The training-data operators against brute force, on small tables that hold every odd case."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from spindrift.llm import bpe, common, language_id, line_dedup, lsh_ann, mixing, pitman_yor, quality_gam, simhash, suffix_dedup, vector_graph
from spindrift.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, key int, doc int, score int"
SF = "/root/testdata/sf0.01"


def some_texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(8) for _ in range(3)]
    out = []
    for i in range(40):
        parts = [line(rng.randrange(1, 12)) for _ in range(rng.randrange(0, 6))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), ("  " + shared[i % 9 // 3] + "\t").upper() if i % 2 else shared[i % 9 // 3])
        out.append("\n".join(parts))
    return [*out, out[7], out[7] + " end", None, "", " \t\n", "\n\n", "x", line(9000), "é" * 19, "é" * 20, "12 34"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = some_texts()
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "ä"][i % 4], None if t is None else len(t), "x", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a text without an id", "en", "a", 5, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 202), (202, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def brute_lines(rows, min_docs=3, min_chars=20):
    space = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(space))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(lower(line)) >= min_chars and i is not None:
                held[lower(line)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or keeper.get(lower(x), i) == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]  # the table has a column n_lines
    got = [(r["doc_id"], r["text"], r["_n_lines"], r["n_dropped"]) for r in out.collect()]
    assert ordered(got) == ordered(brute_lines(texts_of(docs)))
    assert sum(g[3] for g in got) > 5
    assert line_dedup.dedup_lines(none).collect() == []


def brute_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components(docs, none):
    rows = texts_of(docs)
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    part = components(len(rows), links)
    least = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None) if any(rows[i][0] is not None and part[i] == p for i in range(len(rows))) else None for p in set(part)}
    want = [(i, f, least[p]) for (i, _), f, p in zip(rows, prints, part, strict=True)]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(docs, tile=4).collect()]
    assert ordered(got) == ordered(want)
    assert simhash.simhash_components(none).collect() == []


def test_tiles_lose_no_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(5)})
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p, 0) for i, p in enumerate(prints)], "node long, fp long, band int")
    for radius, parts, step in ((2, 4, 1), (3, 8, 1), (16, 1, 8)):
        links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
        found = simhash.tile_links(frame, radius, parts, step, tile=16).collect()
        assert all((prints[r["a"]] ^ prints[r["b"]]).bit_count() == r["distance"] <= radius for r in found)
        assert components(len(prints), [(r["a"], r["b"]) for r in found]) == components(len(prints), links)


def test_near_duplicates_are_verified(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, group = [], {}
    for g in range(12):
        base = [word() for _ in range(300)]
        for k in range(6):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(300)] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "one two", "one two", "ONE two"])]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} or ({t} if t else set()) for t in (tuple((x or "").lower().split()) for _, x in rows)]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    got = {r["doc"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=8).collect()}
    assert [got[i] for i in range(len(rows))] == components(len(rows), links)


def test_near_duplicates_around_the_limit(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(300)]
        for _ in range(40):
            own = list(base)
            for at in rng.sample(range(300), 4):  # any two are about 0.75 to 0.85 alike
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (tuple(x.split()) for _, x in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r["doc"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=64).collect()}
    assert [got[i] for i in range(len(rows))] == components(len(rows), links)


def test_short_near_duplicates_are_all_found(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.randrange(5, 14))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[1:])), (len(rows) + 2, " ".join([*base, "tail"])), (len(rows) + 3, " ".join(base))]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in (tuple(x.split()) for _, x in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    # A radius of zero proposes equal fingerprints only, so links of texts of up to eight shingles come from their marks.
    got = {r["doc"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=0, whole=0).collect()}
    short = [(i, j) for i, j in links if max(len(sets[i]), len(sets[j])) <= 8]
    assert all(got[i] == got[j] for i, j in short)
    assert any(sets[i] != sets[j] for i, j in short)
    whole = {r["doc"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [whole[i] for i in range(len(rows))] == components(len(rows), links)


def test_a_tile_pair_is_decided_whole():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(100, rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 63, 1)
        sets.append(np.unique(own))
    sets.append(np.zeros(0, np.uint64))
    codes, names = np.zeros((2, len(sets)), np.uint64), np.arange(len(sets)) * 10
    for sides in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        alike = [(i, j) for i in range(len(sets)) for j in range(i) if (not sides.any() or sides[i] != sides[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        found = simhash.decide_open(names, codes, np.arange(len(sets)), sets, sides, 20, 32, 0.8)
        pairs = [(a // 10, b // 10) for a, b in found]
        assert {(max(p), min(p)) for p in pairs} <= set(alike)
        assert components(len(sets), pairs) == components(len(sets), alike)
        assert len(pairs) < len(sets)


def test_pitman_yor(docs, none, spark):
    rows = texts_of(docs)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for i, t in rows if i is not None and not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = pitman_yor.score_documents(docs, sweeps=4, burn_in=1)
    got = ordered((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out.collect())
    want = ordered((i, held[i], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert got == want
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in out.collect())
    assert pitman_yor.score_documents(none).collect() == []
    alone = pitman_yor.score_documents(spark.createDataFrame([(None, "only this")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["train_tokens"] == 0


def test_room_probabilities_add_up(spark):
    """Over all words and the unknown one, after any context, cut into pieces or not."""
    rng = random.Random(3)
    words = [f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(6000)]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40]), i % 5 == 0) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc long, text string, held boolean")
    counted = common.stored(pitman_yor.count_words(frame.where("not held").select("text")))
    own = pitman_yor.make_plan(counted, 120, 6, 700)  # at most 64 words are numbered, the rest is named by a hash
    assert 0 < own.start < counted.count() and (own.pieces > 1).any() and (own.pieces == 1).any() and own.buckets > 1
    known = [r["word"].decode() for r in counted.where("word <> X'0A'").collect()]
    every = [*known, "zz"]  # all words of training, and one that it lacks
    pairs = [*(" ".join(f"{u} {w}" for w in every) + f" {u}" for u in every), *every, ""]
    frame = frame.where("not held").unionByName(spark.createDataFrame([(1000 + i, t, True) for i, t in enumerate(pairs)], "doc long, text string, held boolean"))
    plan, base = common.Shipped(spark, own), len(own.counts)
    rooms = common.stored(pitman_yor.gather_rooms(pitman_yor.pack_documents(frame, plan), base))
    named = common.stored(pitman_yor.named_counts(rooms))
    assert named.count() == counted.count() - own.start
    parent = pitman_yor.Parent.first(*pitman_yor.alike(own.counts[:-1], named))
    now = pitman_yor.Round(0, parent, parent.of(own.counts[:-1]), 0.6, 2.0, 4, 1, 1)
    full = common.stored(pitman_yor.dealt(rooms, pitman_yor.members_of(rooms), named))
    top, later, cut, weights = pitman_yor.run_round(full, plan, now)
    end = own.words[pitman_yor.END]  # nothing follows it
    assert set(cut) | {end} == set(np.flatnonzero((own.pieces > 1) & (own.counts > 0)).tolist()) | {end} and np.isfinite(weights).all()
    assert (top > 0).all() and later.count() == named.count()
    total, seen = Counter(), set()
    for r in full.where("kind = 1").collect():
        keys, names = pitman_yor.risen(r["keys"], np.uint64), pitman_yor.risen(r["names"], np.int64)
        b = pitman_yor.swept(own, now, r["bucket"], keys, pitman_yor.unpacked(r["counts"], np.int64), pitman_yor.unpacked(r["held"] or b"", np.int64))
        code = lambda x: int(x) if x < base else -1 - int(names[x - base])  # noqa: E731, B023
        for key, chance in zip(b.keys.tolist(), pitman_yor.chances(now, cut, b).tolist(), strict=True):
            u, w = code(key >> pitman_yor.BITS), code(key & ((1 << pitman_yor.BITS) - 1))
            assert (u, w) not in seen
            seen.add((u, w))
            total[u] += chance
    assert len(seen) == (len(every) + 1) ** 2 and end not in total
    assert list(total.values()) == pytest.approx([1.0] * (len(every) + 1))
    fitted = pitman_yor.Parent.fit(np.array([1, 2, 7]), np.array([5, 3, 1]), np.random.default_rng(0), 6, 2)
    assert fitted.of(np.array([1] * 5 + [2] * 3 + [7])).sum() + fitted.unknown == pytest.approx(1)


def test_scores_do_not_depend_on_which_words_are_numbered(spark):
    """Words below a share of the corpus keep their contexts, so the size of the corpus does not choose the model."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(60)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    all_numbered, few = ({r["doc_id"]: r for r in pitman_yor.score_documents(frame, share=share, bucket=700).collect()} for share in (20, 3))
    tokens = sum(r["n_tokens"] for r in few.values())
    assert sum(r["score"] for r in few.values()) / tokens == pytest.approx(sum(r["score"] for r in all_numbered.values()) / tokens, abs=0.004)
    for i, r in few.items():
        assert r["n_known"] == all_numbered[i]["n_known"] and r["base_score"] == pytest.approx(all_numbered[i]["base_score"])
        assert r["score"] / r["n_tokens"] == pytest.approx(all_numbered[i]["score"] / r["n_tokens"], abs=0.1)


def test_named_words_travel_packed(spark, monkeypatch):
    """A bucket and a range of names are one row, not one for each word, and the words' counts come back in their order."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.3)) % 3000}" for _ in range(40)), i % 5 == 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc long, text string, held boolean")
    counted = common.stored(pitman_yor.count_words(frame.where("not held").select("text")))
    own = pitman_yor.make_plan(counted, 160, 4, 2000)
    plan = common.Shipped(spark, own)
    rooms = common.stored(pitman_yor.gather_rooms(pitman_yor.pack_documents(frame, plan), len(own.counts)))
    assert pitman_yor.members_of(rooms).count() <= 16 * own.buckets
    members, named = common.stored(pitman_yor.members_of(rooms, 3)), common.stored(pitman_yor.named_counts(rooms))
    assert own.buckets > 1 and named.count() > 500 and 3 < members.count() <= 3 * own.buckets
    count = {xxhash.xxh64_intdigest(bytes(r["word"])) >> 1: r["n"] for r in counted.collect()}
    held = {r["bucket"]: r["held"] for r in pitman_yor.customers_of(members, named, 3).collect()}
    words_ = {r["bucket"]: pitman_yor.risen(r["names"], np.int64).tolist() for r in rooms.where("kind = 1").collect()}
    assert {b for b, names in words_.items() if names} == set(held)
    for b, h in held.items():
        assert pitman_yor.unpacked(h, np.int64).tolist() == [count.get(n, 0) for n in words_[b]]
    parent = pitman_yor.Parent.first(*pitman_yor.alike(own.counts[:-1], named))
    now = pitman_yor.Round(0, parent, parent.of(own.counts[:-1]), 0.6, 2.0, 2, 1, 1)
    full = common.stored(pitman_yor.dealt(rooms, pitman_yor.members_of(rooms), named))
    one = pitman_yor.run_round(full, plan, now)
    monkeypatch.setattr(pitman_yor, "BLOCK", 7)
    other = pitman_yor.run_round(full.repartition(5), plan, now)
    assert (one[0] == other[0]).all() and one[2] == pytest.approx(other[2]) and one[3] == pytest.approx(other[3])
    assert sorted(map(tuple, one[1].collect())) == sorted(map(tuple, other[1].collect()))


def test_seating_equals_a_sampler_that_moves_one_customer_at_a_time():
    rng, d, strength = random.Random(1), 0.6, 1.5
    parent = np.array([0.4, 0.3, 0.2, 0.1])
    customers = {0: [9, 1, 4, 2], 1: [0, 30, 2, 0], 2: [1, 1, 0, 0]}
    want = {}
    for u, counts in customers.items():
        people = [w for w, n in enumerate(counts) for _ in range(n)]
        tables: dict = {w: [] for w in range(4)}  # sizes of each dish's tables
        at = []
        for w in people:
            tables[w].append(1)
            at.append((w, tables[w]))
        sums, rounds = np.zeros(4), 3000
        for r in range(rounds + 300):
            for w in people:
                own = tables[w]
                leave = rng.choices(range(len(own)), own)[0]
                own[leave] -= 1
                if not own[leave]:
                    own.pop(leave)
                total = sum(map(len, tables.values()))
                chance = [n - d for n in own] + [(strength + d * total) * parent[w]]
                to = rng.choices(range(len(chance)), chance)[0]
                if to == len(own):
                    own.append(0)
                own[to] += 1
            if r >= 300:
                sums += [len(tables[w]) for w in range(4)]
        want[u] = sums / rounds
    key = [(u, w, n) for u, counts in customers.items() for w, n in enumerate(counts) if n]
    u, w, n = (np.array(x) for x in zip(*key, strict=True))
    got = pitman_yor.sweep_rooms(u, w, n, np.array([16, 32, 2]), parent, d, strength, 6000, 300, np.random.default_rng(2))
    assert got.tables == pytest.approx([want[a][b] for a, b, _ in key], abs=0.12)


def test_seating_is_sane():
    table, rng = pitman_yor.stirling(0.5), np.random.default_rng(0)
    c = np.array([1, 2, 5, 64, 65, 1000, 100000] * 200)
    t = pitman_yor.seat(c, np.full(len(c), 6.0), np.full(len(c), 0.3), 1.0, 0.5, table, rng)
    assert ((t >= 1) & (t <= c)).all()
    # Two customers: one table by 1 - d, two by the pull of the second.
    two = pitman_yor.seat(np.full(20000, 2), np.full(20000, 4.0), np.full(20000, 0.4), 1.0, 0.5, table, rng)
    assert (two == 2).mean() == pytest.approx(1.4 / 1.9, abs=0.02)
    assert pitman_yor.log_gamma(np.array([0.3, 1.0, 4.5, 100.0])) == pytest.approx([1.0957979948180756, 0.0, 2.453736570842442, 359.1342053695754], abs=1e-6)
    a = np.array([3, 3, 900, 2**40], np.uint64)
    assert (pitman_yor.risen(pitman_yor.steps(a), np.uint64) == a).all() and len(pitman_yor.unpacked(pitman_yor.packed(a[:0]), np.uint64)) == 0


def test_language_model_beats_the_unigram_on_held_out_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    out = pitman_yor.score_documents(frame).where("held_out").toPandas()
    assert out["score"].sum() > 0.8 * out["base_score"].sum()
    known = out[out["n_known"] == out["n_tokens"]]
    assert len(known) > 10 and known["score"].sum() > 0.9 * known["base_score"].sum()


def test_language_model_depends_on_word_order_and_not_on_partitions(spark):
    rng = random.Random(9)
    chain = lambda n: " ".join(f"w{x}" for s in [rng.randrange(40)] for x in ((s + 7 * i) % 40 for i in range(n)))
    texts = [chain(rng.randrange(5, 60)) for _ in range(300)]
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 1]
    turned = [" ".join(reversed(t.split())) if i in held[::2] else t for i, t in enumerate(texts)]
    frame = spark.createDataFrame(list(enumerate(turned)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(frame, bucket=2000).collect()}
    bits = lambda ids: sum(got[i]["score"] for i in ids) / sum(got[i]["n_tokens"] for i in ids)
    assert bits(held[1::2]) > bits(held[::2]) + 1
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(frame.repartition(7), bucket=2000).collect()}
    assert all(got[i]["score"] == pytest.approx(s, rel=1e-12) for i, s in again.items())


def test_a_document_may_go_on_in_the_next_chunk(spark, monkeypatch):
    frame = spark.createDataFrame([(i, " ".join(f"w{j % 11}" for j in range(n))) for i, n in enumerate([3, 50, 400, 7])], "doc_id long, text string").coalesce(1)
    whole = ordered(map(tuple, pitman_yor.score_documents(frame).collect()))
    monkeypatch.setattr(pitman_yor, "CHUNK", 100)
    monkeypatch.setattr(pitman_yor, "words_of", lambda data, block=0: common.words_of(data, 64))
    pieces = ordered(map(tuple, pitman_yor.score_documents(frame).collect()))
    assert [x[:5] for x in pieces] == [x[:5] for x in whole] and [x[6] for x in pieces] == pytest.approx([x[6] for x in whole])


def test_quality_model(docs, none, spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_gam.score_quality(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    marks = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(40)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    out = quality_gam.score_quality(docs, marks).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    unlabelled = quality_gam.score_quality(docs, marks.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in unlabelled} == {(0.5, 1)}
    assert quality_gam.score_quality(none, marks).collect() == []


def brute_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((i, len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_are_removed(docs, none, spark):
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, length=40).collect()]
    assert ordered(got) == ordered(brute_repeats(texts_of(docs), 40))
    rng = random.Random(3)
    passage = ["".join(rng.choice("ab c") for _ in range(90)) for _ in range(4)]
    rows = [(i, "".join(rng.choice("abcdefé ") for _ in range(rng.randrange(120))) + passage[i % 4][i % 7 :] + "".join(rng.choice("xyz") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100, "ab" * 100), (101, "z" * 39), (102, "z" * 40), (103, "z" * 41)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = ordered(brute_repeats(rows, 40))
    assert ordered(tuple(r) for r in suffix_dedup.remove_repeats(frame, length=40).collect()) == want
    hot, suffix_dedup.HOT = suffix_dedup.HOT, 100  # every route with two contexts is cut into windows
    try:
        assert ordered(tuple(r) for r in suffix_dedup.remove_repeats(frame, length=40).collect()) == want
    finally:
        suffix_dedup.HOT = hot
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_copies_have_their_runs_once(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [(i, text) for i in range(50)] + [(50, "start " + text[100:300] + " end")]
    tables = []
    monkeypatch.setattr(suffix_dedup, "stored", lambda df: tables.append(common.stored(df)) or tables[-1])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40).collect()
    assert ordered(map(tuple, got)) == ordered(brute_repeats(rows, 40))
    runs = next(t for t in tables if "windows" in t.columns)
    assert runs.count() == runs.select("text_key", "start").distinct().count()


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(200):
        s = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 100))], np.int64)
        assert suffix_dedup.suffix_array(s, 1, 10**9).tolist() == sorted(range(len(s)), key=lambda i: tuple(s[i:]))
        cut = [tuple(s[i : i + 8]) for i in suffix_dedup.suffix_array(s, 1, 8)]
        assert cut == sorted(cut)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_the_library(docs, none, spark, tokenizer):
    odd = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> \n y", "   lead", "a" * 3000, "!?" * 900, " \n\t x", "日本語🎉🎉", "don't we'll", "\x00\x1f\x7f", "".join(chr(random.Random(1).randrange(32, 0x2FFF)) for _ in range(3000))]
    rows = texts_of(docs) + [(1000 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)), ids))
    got = bpe.bpe_round_trip(frame, bpe.vocabulary_path(), keep_ids=True, keep_text=True)
    assert ordered(tuple(r)[:5] for r in got.collect()) == ordered(want)
    assert all(r["decoded"] == (dict(rows)[r["doc_id"]] or "") for r in got.collect() if r["doc_id"] is not None)
    assert bpe.bpe_round_trip(none, bpe.vocabulary_path()).collect() == []


def test_transducer_with_any_merges():
    rng = random.Random(4)
    for _ in range(500):
        vocab = {bytes([c]): i for i, c in enumerate(b"abc")}
        merges = []
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) <= 12:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        m = bpe.Merges(vocab, merges, {})
        s = bytes(rng.choice(b"abc") for _ in range(rng.randrange(200)))
        assert list(bpe.transduce(s, m)) == bpe.merge_all([m.single[b] for b in s], m.rank, m.made)


def test_decoder_holds_back_unfinished_characters():
    letters = {b: c for c, b in bpe.byte_letters().items()}
    m = bpe.Merges.from_json(json.dumps({"added_tokens": [], "model": {"vocab": {letters[b]: b for b in range(256)}, "merges": []}}))
    decoder = bpe.Decoder(m)
    parts = [decoder.feed([b]) for b in "é🎉".encode()] + [decoder.feed([0xC3], True)]
    assert parts == ["", "é", "", "", "", "🎉", "�"]


def vectors(spark, seed=0, n=300, copies=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x = np.r_[x, x[:copies] + 0.02 * rng.normal(size=(copies, 8)), np.repeat(x[5:6], 30, axis=0)]
    rows = [(i, [float(np.float32(v)) for v in row], int(i % 3)) for i, row in enumerate(x)]
    rows += [(9000, None, 1), (9001, [0.0] * 8, 1), (9002, [float("nan")] * 8, 1), (9003, [1.0] * 7 + [float("inf")], 1), (9004, [1.0] * 7 + [None], 1), (9005, [1.0] * 5, 1), (9006, rows[5][1], None), (None, rows[5][1], 0), rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def good(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_nearest(rows, k=20):
    held = {(i, tuple(v)) for i, v in rows if i is not None and good(v)}
    out = {}
    for q, qv in sorted(held):
        if q % 20 == 0:
            score: dict = {}
            for i, v in held:
                if i != q:
                    score[i] = max(score.get(i, -np.inf), float(np.dot(np.array(qv), np.array(v))))
            out[q] = sorted((-round(s, 9), i) for i, s in score.items())[:k]
    return out


def recall(frame, rows):
    """Of the hashed search; every row that it returns must have its rank and score."""
    from pyspark.sql import functions as F

    want, got = brute_nearest(rows), defaultdict(list)
    for r in lsh_ann.nearest(frame, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect():
        got[r["query_id"]].append((r["rank"], -round(r["score"], 9), r["vec_id"]))
    assert set(got) == set(want)
    exact = {(i, j): s for i, found in brute_nearest(rows, 10**6).items() for s, j in found}
    for i, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(want[i]) + 1))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert all(exact[i, j] == pytest.approx(s) for _, s, j in found)
    return sum(len({x[2] for x in got[i]} & {j for _, j in want[i]}) for i in want) / sum(map(len, want.values()))


def test_nearest_neighbours(spark):
    from pyspark.sql import functions as F

    frame, rows = vectors(spark)
    assert recall(frame, [r[:2] for r in rows]) >= 0.9
    assert lsh_ann.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert lsh_ann.nearest(frame.where("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []
    other = frame.withColumnsRenamed({"label": "score"}).withColumns({"id": F.lit("x"), "v": F.lit(1), "rank": F.lit(2), "bucket": F.lit(0)})
    assert lsh_ann.nearest(other, F.col("vec_id") % 20 == 0).count() == lsh_ann.nearest(frame, F.col("vec_id") % 20 == 0).count()


@pytest.mark.parametrize("factor", [1.0, 10.0])
def test_nearest_neighbours_of_any_lengths(spark, factor):
    """Hashed buckets only: a few hundred vectors, one far longer than the rest, or all of mixed lengths."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)) * (np.exp(rng.normal(size=(600, 1))) if factor == 1.0 else 1.0)
    x[17] *= factor
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    assert recall(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows) >= 0.9


def test_probes_come_by_chance_of_success():
    hashes = lsh_ann.Hashes(4, 6, 1, {0: 1.0}, 2.4, 1.0, 3)
    q = np.random.default_rng(1).normal(size=(5, 4))
    some, more = hashes.probes(q, 0, 0.5), hashes.probes(q, 0, 0.9)
    for a, b in zip(some, more, strict=True):
        assert len(a) < len(b) <= 3**6 and (b[: len(a)] == a).all() and len({tuple(c) for c in b}) == len(b)


def test_nearest_neighbours_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    held, lsh_ann_good = [(r[0], list(r[1])) for r in frame.collect()], good
    globals()["good"] = lambda v: v is not None and any(v)
    try:
        assert recall(frame, held) >= 0.9
    finally:
        globals()["good"] = lsh_ann_good


def test_mixing(docs, none):
    out = mixing.mix_sizes(docs, block=16, shards=5).collect()
    again = mixing.mix_sizes(docs.repartition(3), block=16, shards=5).collect()
    assert ordered(map(tuple, out)) == ordered(map(tuple, again))
    assert len(out) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in out)
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, mixing.fill_to_caps([sizes[s] for s in names], [5, 2, 1, 5], 1.5, 2.0), strict=True))
    for s in names:
        assert target[s] == pytest.approx(want[s]) and target[s] <= 2 * sizes[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 16
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mix_sizes(none).collect() == [] and mixing.mix_texts(none).collect() == []


def test_mixed_texts_hold_what_was_taken(docs):
    taken = Counter()
    for r in mixing.mix_sizes(docs, block=16, shards=5).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mix_texts(docs, block=16, shards=5)
    assert out.columns == docs.columns
    held = Counter()
    whole = dict(texts_of(docs))
    for r in out.collect():
        held[r["doc_id"]] += len(r["text"].encode().split())
        assert set(r["text"].encode().split()) <= set(whole[r["doc_id"]].encode().split())
    assert held == Counter({k: v for k, v in taken.items() if v})


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 99, -5):
            x = np.arange(n)
            assert sorted(mixing.permuted(x, np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def brute_links(rows, least=0.93):
    once = list({(i, None if v is None else tuple(v), g): None for i, v, g in rows})
    ok = [i is not None and g is not None and good(v) for i, v, g in once]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(once, ok, strict=True)]
    links = [(a, b) for a in range(len(once)) for b in range(a) if ok[a] and ok[b] and once[a][2] == once[b][2] and float(unit[a] @ unit[b]) >= least]
    part = components(len(once), links)
    degree, least_id = Counter(x for p in links for x in p), {}
    for (i, _, _), p in zip(once, part, strict=True):
        if i is not None:
            least_id[p] = min(i, least_id.get(p, i))
    return [(i, degree[k], least_id.get(part[k]), i is not None and i == least_id[part[k]]) for k, (i, _, _) in enumerate(once)]


@pytest.mark.parametrize("block", [1000, 20])
def test_vector_links(spark, monkeypatch, block):
    frame, rows = vectors(spark, 1)
    monkeypatch.setattr(vector_graph, "BLOCK", block)
    monkeypatch.setattr(vector_graph, "CLUSTER", 25)
    from pyspark.sql import functions as F

    other = frame.withColumns({"node": F.lit("x"), "v": F.lit(1), "id": F.lit(2), "weight": F.lit(3), "shards": F.lit(4)})
    assert ordered(map(tuple, vector_graph.link_vectors(other).collect())) == ordered(brute_links(rows))
    assert vector_graph.link_vectors(frame.where("false")).collect() == []


def test_vector_links_of_repeated_ids(spark):
    near = [1.0, 0.1] + [0.0] * 6
    far = [0.0] * 6 + [1.0, 0.1]
    rows = [(5, [1.0] + [0.0] * 7, 1), (6, near, 1), (5, [0.0] * 6 + [1.0, 0.0], 2), (7, far, 2), (8, far, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert ordered(map(tuple, vector_graph.link_vectors(frame).collect())) == ordered([(5, 1, 5, True), (6, 1, 5, False), (5, 1, 5, True), (7, 1, 5, False), (8, 0, 8, True)])


def test_low_recall_is_made_good_exactly(spark, monkeypatch):
    frame, rows = vectors(spark, 2)
    monkeypatch.setattr(vector_graph, "range_search", lambda graph, least: (np.zeros(0, np.int64),) * 2)
    monkeypatch.setattr(vector_graph, "BLOCK", 30)
    assert ordered(map(tuple, vector_graph.link_vectors(frame).collect())) == ordered(brute_links(rows))


def test_graph_search_compares_only_what_it_visits():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 48))
    x = np.r_[x, x[:200] + 0.1 * rng.normal(size=(200, 48)), x[:1] + 0.15 * rng.normal(size=(100, 48))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vector_graph.Graph(x).build()
    assert ((graph.edges >= 0).sum(axis=1) >= 1).all()
    i, at = np.nonzero(graph.edges >= 0)
    graph.join(i, graph.edges[i, at])
    graph.compared = 0
    found = set(zip(*(a.tolist() for a in vector_graph.range_search(graph, 0.93)), strict=True))
    want = set(zip(*(a.tolist() for a in np.nonzero(np.triu(x @ x.T >= 0.93, 1))), strict=True))
    assert found <= want and len(found) >= 0.98 * len(want) and graph.compared < 0.5 * len(x) ** 2


def test_language_identification(docs, none, spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    out = language_id.identify(docs)
    whole = dict(texts_of(docs))
    for r in out.collect():
        lettered = any(c.isalpha() for c in whole[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    assert language_id.identify(none).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang <> ''")).collect()} <= {"und"}


def test_mixtures_of_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 800").select("lang", "text").collect()
    first = {}
    for r in d:
        first.setdefault(r["lang"], r["text"][:700])
    both = spark.createDataFrame([(10**6, first["de"] + " " + first["fr"], None, "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = language_id.identify(spark.read.parquet(f"{SF}/documents.parquet").unionByName(both)).where("doc_id = 1000000").first()
    assert set(r["langs"]) == {"de", "fr"} and all(0.3 < x < 0.7 for x in r["langs"].values())
