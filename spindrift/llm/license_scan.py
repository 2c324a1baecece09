"""License scans by diagonal voting.

Every run of k words of a text is hashed and joined to the places of the same run in license phrases and
notices. A match votes for its diagonal, the word of the text at which the notice would start. Votes
of diagonals near one another add up, so that words put in or left out only bend a match. What has votes
enough is a span, and spans are verified word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch_rows, record_batch, stored, words_of
from .simhash import marked_rows

#: Words of a hashed run, words by which neighbouring diagonals of one match differ at most, and rows of a batch.
RUN, SLACK, ROWS = 3, 4, 200_000

#: Share of a notice's runs that have to vote, and of its words that have to stand in a span in order.
VOTES, SHARE = 0.35, 0.8

#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Notice(NamedTuple):
    """A text that names a license, with phrases that tell it from notices of other licenses."""

    label: str
    text: str
    needs: tuple[str, ...] = ()


#: Short notices as licenses' own texts ask for them.
NOTICES = (
    Notice("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "version 2")),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary",)),
    Notice("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("commons attribution 4",)),
    Notice("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4",)),
    Notice("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4",)),
    Notice("gpl-2", "Licensed under the GNU General Public License, version 2", ("gnu general public", "version 2")),
    Notice("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public", "version 2")),
    Notice("gpl-3", "Licensed under the GNU General Public License, version 3", ("gnu general public", "version 3")),
    Notice("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public", "version 3")),
    Notice("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public",)),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("free of charge",)),
    Notice("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public", "2")),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
)

#: Bytes that are part of a word, A-Z lowered; all others become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    return words_of(as_bytes(text).translate(FOLD))


def all_words(text: str) -> list[bytes]:
    return [w for some in words(text) for w in some]


def run_hashes(some: list[bytes], before: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs that end in these words, given the last words' hashes before them; and the last of these."""
    own = np.concatenate([before, np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))])
    n = len(own) - run + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(run if n > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    return total.view(np.int64), own[max(0, n) :] if n > 0 else own


class Template(NamedTuple):
    label: str
    words: list[bytes]
    needs: list[list[bytes]]
    exact: bool


def templates(phrases: dict[str, str], notices: tuple[Notice, ...]) -> list[Template]:
    exact = [Template(label, all_words(text), [], True) for text, label in phrases.items()]
    return exact + [Template(n.label, all_words(n.text), [all_words(x) for x in n.needs], False) for n in notices]


def template_runs(spark: SparkSession, known: list[Template], run: int) -> DataFrame:
    """``(run, template, at)``: each run of each template. No more rows than the templates have words."""
    rows = []
    for i, t in enumerate(known):
        hashes, _ = run_hashes(t.words, np.zeros(0, np.uint64), run)
        rows += [(int(h), i, at) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "run long, template int, at int")


def voted(docs: DataFrame, known: list[Template], run: int) -> DataFrame:
    """A row for each document with its number of words, and one for each match of a run; stored.

    ``docs`` has ``doc_id``, ``text``, ``key``, ``test``. All runs of all texts are joined to the templates' runs,
    which are few whatever the data: only matches leave the scan.
    """
    schema = pa.schema([("row", pa.int64()), ("at_word", pa.int64()), ("run", pa.int64()), *((c, pa.int64()) for c in ("doc_id", "key", "test"))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            held, size, counts = [], 0, []
            for text in batch.column(1).to_pylist():
                at, before = 0, np.zeros(0, np.uint64)
                for some in words(text):
                    hashes, left = run_hashes(some, before, run)
                    held.append((np.full(len(hashes), row + len(counts)), np.arange(len(hashes)) + at - len(before), hashes))
                    size += len(hashes)
                    at, before = at + len(some), left
                    if size > ROWS:
                        yield runs(held)
                        held, size = [], 0
                counts.append(at)
            yield runs(held)
            yield record_batch(schema, (np.arange(len(counts)) + row, counts, pa.nulls(len(counts), pa.int64()), batch.column(0), batch.column(2), batch.column(3)))
            row += len(counts)

    def runs(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(3)]
        none = pa.nulls(len(columns[0]), pa.int64())
        return record_batch(schema, (*columns, none, none, none))

    spark = docs.sparkSession
    ddl = "row long, at_word long, run long, doc_id long, key long, test long"
    with batch_rows(spark, 500):
        found = docs.select("doc_id", "text", "key", "test").mapInArrow(rows, ddl).join(F.broadcast(template_runs(spark, known, run)), "run", "left")
        return stored(found.where("run is null or template is not null").drop("run"))


def spans(table: DataFrame, known: list[Template], run: int) -> DataFrame:
    """``(row, template, start, length)``: stretches of words that have votes enough to be verified."""
    spark = table.sparkSession
    limits = [(i, t.exact, len(t.words), (len(t.words) - run + 1) if t.exact else max(2, math.ceil(VOTES * (len(t.words) - run + 1)))) for i, t in enumerate(known)]
    limits = F.broadcast(spark.createDataFrame(limits, "template int, exact boolean, size int, votes_needed int"))
    votes = table.where("template is not null").groupBy("row", "template", (F.col("at_word") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    votes = votes.join(limits, "template")
    exact = votes.where("exact and votes = votes_needed").select("row", "template", F.col("diagonal").alias("start"), F.col("size").cast("long").alias("length"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = votes.where("not exact").withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 40)).over(by) > SLACK).cast("int"))
    near = near.withColumn("match", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = near.groupBy("row", "template", "match").agg(F.sum("votes").alias("votes"), F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).alias("best"), F.first("size").alias("size"), F.first("votes_needed").alias("votes_needed"))
    bent = merged.where("votes >= votes_needed").select("row", "template", F.greatest(F.col("best") - SLACK, F.lit(0)).alias("start"), (F.col("size") + 2 * SLACK).cast("long").alias("length"))
    return exact.unionByName(bent)


def holds(part: list[bytes], whole: list[bytes]) -> bool:
    return any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))


def share_of(t: Template, span: list[bytes]) -> float:
    """The share of a template's words that stand in the span in order; 0 if what tells it apart is not there."""
    if t.exact:
        return float(span == t.words)
    if not all(holds(x, span) for x in t.needs):
        return 0.0
    return sum(b.size for b in SequenceMatcher(None, t.words, span, autojunk=False).get_matching_blocks()) / len(t.words)


def verified(texts: DataFrame, known: list[Template]) -> DataFrame:
    """``texts``: ``key, test, text, spans``. Spans that fail go; the rest are summed up for each text."""
    ints = ("key", "test", "n_base", "first_word", "last_word")
    schema = pa.schema([*((c, pa.int64()) for c in ints), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def check(text: str, asked: list[dict]) -> tuple:
        need = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["length"]) for s in asked]))
        held, at = {}, 0
        for some in words(text):
            low, high = np.searchsorted(need, (at, at + len(some)))
            held.update((int(p), some[int(p) - at]) for p in need[low:high])
            at += len(some)
        base, labels, score = [], set(), 0.0
        for s in asked:
            t = known[s["template"]]
            share = share_of(t, [held[p] for p in range(s["start"], s["start"] + s["length"]) if p in held])
            if t.exact and share == 1:
                base.append((s["start"], t.label))
            if share >= SHARE:
                labels.add(t.label)
                score = max(score, share)
        places = [p for p, _ in base]
        join = lambda names: ",".join(sorted(names))
        return len(places), min(places, default=None), max(places, default=None), join({x for _, x in base}), join(labels), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check(t, s) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield record_batch(schema, (batch.column(0), batch.column(1), *(list(zip(*found, strict=True)) or [[]] * 6)))

    ddl = "key long, test long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return texts.select("key", "test", "text", "spans").mapInArrow(run, ddl)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Words are runs of letters a-z (A-Z lowered), digits and characters beyond ASCII. ``n_base`` counts the places
    where a phrase of ``phrases`` stands word for word; ``first_word`` and ``last_word`` are the smallest and
    the largest of them, and ``base_labels`` their labels. ``labels`` has these and the labels of ``notices``, of
    which at least 0.8 of the words stand in order. ``score`` is the largest share found, 1 for a phrase.
    Every phrase and notice needs three words at least.

    Null or empty text: no words, null places, empty labels, score 0. Null id: the row returns with it. Repeated
    rows: each returns. Ties, places of two phrases that overlap: all count. Very long texts are read in parts,
    runs go on across them. Empty table: empty result. Extra columns are ignored.
    """
    known = templates(PHRASES if phrases is None else phrases, notices)
    if any(len(t.words) < RUN for t in known):
        raise ValueError(f"a phrase or notice has fewer than {RUN} words")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumns({"key": F.xxhash64("doc_id", "text"), "test": F.xxhash64(F.lit(1), "text")})
    table = voted(own, known, RUN)
    rows = table.where("template is null").select("row", "doc_id", "key", "test", F.col("at_word").alias("n_words"))
    found = stored(spans(table, known, RUN))
    asked = found.join(rows.select("row", "key", "test"), "row").select("key", "test", F.struct("template", "start", "length").alias("s"))
    # A text's spans are no more than its words.
    asked = stored(asked.groupBy("key", "test").agg(F.collect_set("s").alias("spans")))
    held = marked_rows(own.select(F.col("key").alias("doc"), "text"), asked.select(F.col("key").alias("doc")))
    held = held.select(F.col("doc").alias("key"), F.xxhash64(F.lit(1), "text").alias("test"), "text")
    with batch_rows(docs.sparkSession, 500):
        checked = stored(verified(held.join(asked, ["key", "test"]), known))
    checked = checked.dropDuplicates(["key", "test"])
    out = rows.join(checked, ["key", "test"], "left")
    empty = F.lit("")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", empty).alias("base_labels"), F.coalesce("labels", empty).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
