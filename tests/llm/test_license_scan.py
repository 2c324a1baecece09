"""License scans against a plain search, and notices with words put in, left out and changed."""

import random
import re

import pytest

from spindrift.llm import license_scan as ls

SCHEMA = "doc_id long, text string, labels string, row int, key string, n_words int"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        phrase = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(2)
    bits = ["under the MIT", "license", "Apache License, Version 2", ".0", "CC BY-NC", "cc", "by", "nc", "under", "the", "x", "é", "mit\nlicense", "version 2"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(60)]
    return [*out, None, "", " ", "under the mit license", "UNDER\tTHE\x00MIT-LICENSE", "under the mit licensé", "cc by ncc", "cc by nc by nc cc by nc"]


@pytest.mark.parametrize("block", [None, 7])
def test_base_places(spark, monkeypatch, block):
    rows = list(enumerate(texts()))
    rows += [rows[3], rows[3], (4, "another text: cc by nc"), (None, "Under the MIT license"), (None, None)]
    if block:  # runs that go on over parts of a text
        monkeypatch.setattr(ls, "words", lambda text: ls.words_of(ls.as_bytes(text).translate(ls.FOLD), block))
        known = ls.templates(ls.PHRASES, ())
        for _, text in rows:
            whole = ls.all_words(text or "")
            hashes, _ = ls.run_hashes(whole, ls.np.zeros(0, ls.np.uint64), 3)
            before, got = ls.np.zeros(0, ls.np.uint64), []
            for some in ls.words(text):
                part, before = ls.run_hashes(some, before, 3)
                got += part.tolist()
            assert got == hashes.tolist()
        assert [t.label for t in known] == ["mit", "apache-2", "cc-by-nc"]
        return
    df = spark.createDataFrame([(*r, "x", 1, "k", 2) for r in rows], SCHEMA).repartition(3)
    out = ls.scan_licenses(df).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=order)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=order)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)


def test_notices(spark):
    filler = " ".join(["of", "the", "software", "this", "work", "in", "any", "form"] * 40)
    gpl = "This program is free software: you may redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License or any later version."
    cases = {
        1: (f"{filler} {gpl} {filler}", "gpl-3"),
        2: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        3: ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        4: ("Permission is granted, free of charge, to any person obtaining a copy of this software and its associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense and/or sell copies of the Software", "mit"),
        5: (filler, ""),
        6: ("The public is free to work with the general software license of this program, version by version, as it is published", ""),
        7: (f"{gpl} {filler} Released under the MIT License. {gpl}", "gpl-3,mit"),
        8: (" ".join([gpl] * 30), "gpl-3"),
        9: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    }
    df = spark.createDataFrame([(i, t, "", 1, "", 1) for i, (t, _) in cases.items()], SCHEMA)
    out = {r.doc_id: r for r in ls.scan_licenses(df).collect()}
    assert {i: r.labels for i, r in out.items()} == {i: want for i, (_, want) in cases.items()}
    assert out[7].score == 1 and out[5].score == 0 and 0.8 <= out[1].score <= 1 and out[7].n_base == 1


def test_empty_and_short_phrases(spark):
    assert ls.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        ls.scan_licenses(spark.createDataFrame([], SCHEMA), {"two words": "x"})
