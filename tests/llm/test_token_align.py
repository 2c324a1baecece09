"""Cross-tokenizer alignment against a brute force that compares every token with every other."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from spindrift.llm import token_align as ta
from spindrift.llm.bpe import byte_letters

SCHEMA = "doc_id long, text string, chunk int, code int, n long"


@pytest.fixture(scope="module")
def whole():
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def tokens(text):
        a = one.encode(" " + text, add_special_tokens=False)
        b = two.encode(text)
        raw = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)], [(i, raw(i)) for i in b]

    return tokens


def brute(tokens, rows):
    found, df = [], Counter()
    for key, text in rows:
        a, b = tokens(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append((key, 0, 0, 0, [], ""))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans))
            low = high
        df.update(set(links))
        found.append((key, len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (i, _), n in df.items():
        most[i] = max(most[i], n)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    return sorted(((k, na, nb, g, len(x), sum(df[p] == most[p[0]] for p in x), sum(df[p] for p in x), h) for k, na, nb, g, x, h in found), key=order)


def texts():
    rng = random.Random(3)
    words = ["the", "Antidisestablishment", "naïve", "x1", "foo.bar()", "don't", "日本語", "😀😀", "é", "\t", "", "", "\n", "12345", "▁", "<|endoftext|>", "</s>", " ", "　x", "q" * 70]
    out = [" ".join(rng.choice(words[:14]) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    out += ["", None, " ", "  lead", "trail  ", "a\n b", "a  b", "▁x", "ﬁne", "a\u0000b", "<|endoftext|> <s>", *words, "é", "\x1c x", "x\x85 y", "a​ b"]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("sizes", [None, (50, 7, 40)])
def test_equals_brute_force(spark, whole, monkeypatch, sizes):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (3, "another text of this id"), (None, "no id"), (None, None)]
    want = brute(whole, rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    if sizes is None:
        assert rows_of(ta.token_links(df, *ta.public_vocabularies())) == want
        return
    # The same with blocks that end inside of texts, words that are dropped, and several chunks.
    for name, size in zip(("WORDS", "BLOCK", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(ta, name, size)
    words = ta.Vocabularies(*ta.public_vocabularies()).words()
    got = list(ta.aligned_texts(words, iter(rows)))
    plain = {(k, na, nb, g, n, h) for k, na, nb, g, n, _, _, h in want}
    assert {r[:6] for r in got} == plain and len(got) == len(rows)
    assert [int(r[7].sum()) for r in got] == [r[4] for r in got]


def test_a_text_longer_than_every_part(whole):
    text = " ".join(random.Random(1).choices(["alpha", "beta\n", "  ", "gamma", "Überraschung"], k=400_000))
    assert len(text) > 2 << 20
    words = ta.Vocabularies(*ta.public_vocabularies()).words()
    (row,) = ta.aligned_texts(words, iter([(1, text)]))
    a, b = whole(text)
    assert row[1:3] == (len(a), len(b))
    ends = [np.cumsum([len(raw) for _, raw in side]) for side in (a, b)]
    assert row[3] == len(np.intersect1d(*ends))
    assert row[4] == len(a) + len(b) - row[3]  # every end that only one side has starts one more link


def test_gallop_finds_what_a_plain_search_finds():
    rng = np.random.default_rng(5)
    for n, m in [(0, 5), (5, 0), (1, 1), (300, 20), (20, 3000), (1000, 1000)]:
        asked, among = np.unique(rng.integers(0, 5000, n)), np.unique(rng.integers(0, 5000, m))
        want = np.searchsorted(among, asked)
        assert (ta.ranks(asked, among, np.zeros(len(asked), np.int64)) == want).all()


def test_encoders_agree_below_the_limit(whole):
    words = ta.Vocabularies(*ta.public_vocabularies()).words()
    assert words.apart
    for c in map(chr, range(1, 0x250)):
        for text in (f"a{c}b", f"a {c}b", f"1{c}{c} c", f"{c} {c}", f"'{c}s"):
            assert words.fast.encode_ordinary(" " + text) == words.one.encode(" " + text, add_special_tokens=False).ids, text


def test_empty(spark):
    assert ta.token_links(spark.createDataFrame([], SCHEMA), *ta.public_vocabularies()).count() == 0
