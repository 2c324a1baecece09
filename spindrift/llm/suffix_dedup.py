"""Removal of repeated byte strings by suffix arrays, built with the difference-cover algorithm.

Spark brings together what can be equal, and a suffix array decides. The least hash of all short
grams in a window of ``length`` bytes depends on nothing but the window's bytes, so equal windows
share it. Runs of windows with one such value (a context) are routed by it, if the value turns up
in more than one place. Equal contexts are sorted once. Each bucket of contexts, of bounded size,
then gets a suffix array: triples at two of three positions are sorted and named, the names are
sorted by recursion, the remaining suffixes are merged in, and neighbours with ``length`` equal
bytes mark the windows that occur again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, record_batch, small_batches, stored

#: Bytes of a gram; a window's route is the least hash of its grams.
GRAM = 24
#: Bytes of contexts in a bucket; a route with more than ``HOT`` bytes is cut into single windows.
BUCKET, HOT = 1_500_000, 16_000_000
#: Bytes hashed at a time; longer texts are taken in overlapping pieces.
PIECE = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Powers:
    """Powers of the hash base and of its inverse, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, b in (("up", BASE), ("down", inverse)):
                setattr(self, name, np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64))
        return self.up[:n], self.down[:n]


def gram_hashes(data: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A mixed polynomial hash of every gram."""
    n = len(data)
    up, down = powers.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    out, have = h, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def runs_of(pieces: list[bytes], length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """``piece, start, windows, route, twice`` of each run of windows with one route, within pieces.

    ``twice``: the gram with the least hash stands at two places of the run, so the run may hold
    equal windows itself. Each window of a run holds it at least once.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    width = length - GRAM + 1
    h = gram_hashes(data, GRAM, powers)
    least = sliding_least(h, width)
    ends = np.cumsum([len(p) for p in pieces])
    begins = ends - [len(p) for p in pieces]
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, begins[begins < len(least)]]))
    piece = np.searchsorted(ends, cuts, side="right")
    stop = np.minimum(np.r_[cuts[1:], len(least)], ends[piece] - length + 1)
    good = stop > cuts
    cuts, stop, piece = cuts[good], stop[good], piece[good]
    route, grams = least[cuts], np.lib.stride_tricks.sliding_window_view(h, width)
    twice = np.zeros(len(cuts), bool)
    for at in range(0, len(cuts), 4096):
        part = slice(at, at + 4096)
        low = cuts[part] + (grams[cuts[part]] == route[part, None]).argmax(axis=1)
        high = stop[part] + width - 2 - (grams[stop[part] - 1] == route[part, None])[:, ::-1].argmax(axis=1)
        twice[part] = low < high
    return piece, cuts - begins[piece], stop - cuts, route.view(np.int64), twice


def rank_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """Names of triples of symbols up to ``top``, in their order, from 1."""
    bits = max(1, int(top).bit_length())
    if 3 * bits <= 63:
        key = (a << (2 * bits)) | (b << bits) | c
    else:
        pair = np.unique((a << bits) | b, return_inverse=True)[1].astype(np.int64)
        key = (pair << bits) | c
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def suffix_array(s: np.ndarray, span: int, length: int) -> np.ndarray:
    """Order of all suffixes of ``s`` (symbols from 1) by their first ``length`` bytes at least.

    ``span`` is the number of bytes that a symbol stands for. Positions 1 and 2 of every three are
    sampled: any two positions reach sampled ones by a common step of at most two.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    names = rank_triples(t[sampled], t[sampled + 1], t[sampled + 2], int(s.max()))
    if 3 * span < length and names.max() < len(sampled):
        order = suffix_array(names, 3 * span, length)
        rank = np.empty(len(sampled), np.int64)
        rank[order] = np.arange(1, len(sampled) + 1)
    else:
        order, rank = np.argsort(names, kind="stable"), names
    at = np.zeros(n + 3, np.int64)
    at[sampled] = rank
    sampled = sampled[order]
    sampled = sampled[sampled < n]

    top = np.int64(n + 4)
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * top + at[rest + 1], kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(t[first] * top + at[first + 1], t[rest] * top + at[rest + 1])
    pairs = np.unique(np.concatenate([t[second] * top + t[second + 1], t[rest] * top + t[rest + 1]]), return_inverse=True)[1]
    below += np.searchsorted(pairs[: len(second)] * top + at[second + 2], pairs[len(second) :] * top + at[rest + 2])
    out = np.empty(n, np.int64)
    # Suffixes alike in all bytes that count stand in any order; keep theirs from crossing.
    place = np.maximum.accumulate(below) + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, copied: np.ndarray, length: int) -> np.ndarray:
    """Which window starts occur again, for contexts laid end to end; those of copied ones all do."""
    sizes = np.diff(offsets)
    gaps = np.arange(len(sizes))
    s = np.zeros(len(data) + len(sizes), np.int64)
    where = np.arange(len(data)) + np.repeat(gaps, sizes)
    s[where] = data.astype(np.int64) + 2
    s[offsets[1:] + gaps] = 1  # ends a context; no window holds it
    starts = np.zeros(len(s), bool)
    begin = offsets[:-1] + gaps
    left = np.repeat(begin + sizes, sizes) - where
    starts[where] = left >= length
    order = suffix_array(s, 1, length)
    order = order[starts[order]]
    same = np.arange(len(order) - 1)
    text = (s - 1).clip(0, 255).astype(np.uint8)
    text[s > 1] = (s[s > 1] - 2).astype(np.uint8)
    words = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(8, np.uint8)]), (len(text) + 1, 8), (1, 1)).copy().view(np.uint64).ravel()
    for step in [*range(0, length - 7, 8), length - 8]:
        if len(same):
            same = same[words[order[same] + step] == words[order[same + 1] + step]]
    again = np.zeros(len(s), bool)
    again[order[same]] = again[order[same + 1]] = True
    again[where[np.repeat(copied, sizes)]] = True
    return (again & starts)[where]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, and ``kept`` bytes if asked for.

    Texts are UTF-8 bytes. Every byte covered by a ``length``-byte string that also starts anywhere
    else, in any document or the same one, is removed; strings are judged on the input.

    Null or empty text: no bytes, nothing removed. Repeated rows and ids: each row is a document, so
    equal texts of at least ``length`` bytes remove one another. Null id: a document like any other.
    Empty table: empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    run_schema = pa.schema([("text_key", pa.binary()), ("route", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("twice", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            held, size = [], 0

            def emit() -> pa.RecordBatch:
                piece, start, windows, route, twice = runs_of([p for _, _, p in held], length, powers)
                keys = pa.array([k for k, _, _ in held], pa.binary()).take(pa.array(piece))
                return record_batch(run_schema, (keys, route, start + np.array([at for _, at, _ in held])[piece], windows, twice))

            for text in batch.column(0).to_pylist():
                data = as_bytes(text)
                if len(data) < length:
                    continue
                key = xxhash.xxh3_128_digest(data)
                for at in range(0, len(data) - length + 1, PIECE):
                    held.append((key, at, data[at : at + PIECE + length - 1]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield emit()
                        held, size = [], 0
            if held:
                yield emit()

    # Copies have the same runs; one row of each is enough, and is made before the shuffle.
    runs = docs.select("text").mapInArrow(find, "text_key binary, route long, start long, windows long, twice boolean")
    runs = stored(runs.dropDuplicates(["text_key", "start"]))
    place = F.xxhash64("text_key", "start")
    routes = runs.groupBy("route").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("twice").alias("twice")).where("low <> high or twice").select("route")
    wanted = runs.join(routes, "route").groupBy("text_key").agg(F.collect_list(F.struct("start", "windows", "route")).alias("runs"))

    keyed = keyed_texts(docs, length)
    context_schema = pa.schema([("text_key", pa.binary()), ("start", pa.int64()), ("route", pa.int64()), ("context", pa.binary()), ("bytes", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in context_schema]
            for key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = as_bytes(text)
                for run in found:
                    own = data[run["start"] : run["start"] + run["windows"] + length - 1]
                    for column, x in zip(out, (key, run["start"], run["route"], xxhash.xxh3_128_digest(own), own), strict=True):
                        column.append(x)
            yield record_batch(context_schema, out)

    # One text of each key is enough: copies have the same runs.
    texts = keyed.where("text_key is not null").groupBy("text_key").agg(F.first("text").alias("text"))
    contexts = stored(texts.join(wanted, "text_key").select("text_key", "text", "runs").mapInArrow(extract, "text_key binary, start long, route long, context binary, bytes binary"))
    distinct = contexts.groupBy("context").agg(F.first("route").alias("route"), F.first("bytes").alias("bytes"), F.min(place).alias("low"), F.max(place).alias("high"))
    distinct = stored(distinct.select("context", "route", "bytes", (F.col("low") != F.col("high")).alias("copied")))
    weights = distinct.groupBy("route").agg(F.sum(F.length("bytes")).alias("weight"), F.count("*").alias("n"), F.max(F.length("bytes")).alias("longest"))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // BUCKET))
    hot = weights.where((F.col("weight") > HOT) & (F.col("n") > 1)).select("route", F.lit(True).alias("hot"))
    routed = distinct.join(hot, "route", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    mark_schema = pa.schema([("context", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])

    def decide(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = group.column("bytes").combine_chunks() if isinstance(group.column("bytes"), pa.ChunkedArray) else group.column("bytes")
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        again = repeated_windows(data, offsets, group.column("copied").to_numpy(), length)
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        inner = np.zeros(len(again) + 1, bool)
        inner[offsets[:-1]] = True
        split = inner[:-1] & again & np.r_[False, again[:-1]]
        first = np.union1d(np.flatnonzero(edge == 1), np.flatnonzero(split))
        last = np.union1d(np.flatnonzero(edge == -1), np.flatnonzero(split))
        own = np.searchsorted(offsets, first, side="right") - 1
        shift = offsets[own]
        return pa.Table.from_arrays([group.column("context").take(pa.array(own)), pa.array(first - shift), pa.array(last - shift - 1)], schema=mark_schema)

    bucket = F.pmod(F.xxhash64("route"), F.lit(buckets)).alias("bucket")
    ddl = "context binary, first long, last long"
    marks = routed.where("not hot").select("context", "bytes", "copied", bucket).groupBy("bucket").applyInArrow(decide, ddl)
    # Windows of a hot route one by one: equal ones are sorted once, and routed by their bytes.
    single = routed.where("hot").select("context", "copied", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("at"))
    single = single.select("context", "copied", "at", F.expr(f"substring(bytes, at + 1, {length})").alias("bytes")).withColumn("key", F.sha2("bytes", 256))
    kinds = single.groupBy("key").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.max("copied").alias("c")).select(F.col("key").cast("binary").alias("context"), "bytes", ((F.col("n") > 1) | F.col("c")).alias("copied"))
    pieces = F.pmod(F.xxhash64("context"), F.lit(buckets)).alias("bucket")
    hot_marks = kinds.select("context", "bytes", "copied", pieces).groupBy("bucket").applyInArrow(decide, ddl)
    hot_marks = single.withColumn("key", F.col("key").cast("binary")).join(hot_marks.select(F.col("context").alias("key")).distinct(), "key", "left_semi").select("context", F.col("at").alias("first"), F.col("at").alias("last"))
    marks = stored(marks.unionByName(hot_marks))

    spans = contexts.select("text_key", "start", "context").join(marks, "context").groupBy("text_key").agg(F.array_distinct(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")))).alias("spans"))
    copies = keyed.where("text_key is not null").groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1")
    found = copies.join(spans, "text_key", "full").select(F.col("text_key").alias("k"), "copies", "spans")
    joined = keyed.join(found, F.col("text_key") == F.col("k"), "left").select("doc", "text", "copies", "spans")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    out_ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        fields, out_ddl = [*fields, ("kept", pa.binary())], f"{out_ddl}, kept binary"
    out_schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in out_schema]
            for doc, text, copies, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = as_bytes(text)
                gone: list[list[int]] = []
                if copies and len(data) >= length:
                    gone = [[0, len(data)]]
                else:
                    for first, last in sorted((s["first"], s["last"] + length) for s in spans or ()):
                        if gone and first <= gone[-1][1]:
                            gone[-1][1] = max(last, gone[-1][1])
                        else:
                            gone.append([first, last])
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True))
                row = (doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)
                for column, x in zip(out, row, strict=False):
                    column.append(x)
            yield record_batch(out_schema, out)

    return joined.mapInArrow(cut, out_ddl)


def keyed_texts(docs: DataFrame, length: int) -> DataFrame:
    """``(doc, text, text_key)``: the 128-bit hash of texts of at least ``length`` bytes, else null."""
    (name,) = fresh(docs, "text_key")
    schema = pa.schema([("doc", pa.int64()), ("text", pa.string()), (name, pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(d) if len(d := as_bytes(t)) >= length else None for t in batch.column(1).to_pylist()]
            yield record_batch(schema, (batch.column(0), batch.column(1).cast(pa.string()), keys))

    return docs.mapInArrow(run, f"doc long, text string, {name} binary")
