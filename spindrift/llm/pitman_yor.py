"""Language-model scores by a hierarchical Pitman-Yor model, sampled over the whole corpus.

Each preceding word has a restaurant that serves the words which follow it. All of them share one
parent, the restaurant of words without context, whose own parent is an even base over the words of
training, with half for one outcome that stands for all others. Every word of training has a
restaurant and is a dish, whatever its count and the size of the corpus.

Only how a word is named depends on its count: those with at least one token in 2 ** 20 of training
have numbers that every task knows, all others are named by 63 bits of a hash. A bucket lists the
names that it holds, packed by ranges of names. What is known of words in the whole corpus meets
them by range, and comes back to each bucket as one packed array.

Occurrences of word pairs are dealt once, packed, to buckets of restaurants; the restaurant of a
very common word is cut into pieces by the word that follows. In each round, Spark tasks sweep over
the seating of their restaurants (Gibbs: the tables of a dish from their conditional, given all
others), the number of tables of each word is added up, and the driver samples the one parent
restaurant and draws strength and discount on a grid. The parent's base is even, so words with
equally many tables are alike there, and a histogram of these numbers is all that the driver needs.
Probabilities are averaged over the sweeps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, as_bytes, batch_rows, fold_of, record_batch, stored, words_of

#: Bits of a word's number in a bucket, and the share of tokens (1 in 2 ** SHARE) from which every task knows it.
#: By that share no more than 2 ** SHARE words are broadcast, whatever the size of the corpus.
BITS, SHARE = 28, 20
#: Tokens of a bucket of restaurants; a context with more than an eighth of it is cut into pieces.
BUCKET = 1_600_000
#: Ranges that names are cut into where no plan says how many.
RANGES = 16
#: Numbers of a block of words whose tables are added up together.
BLOCK = 1 << 16
#: Tokens and documents that a task packs at a time.
CHUNK, CHUNK_DOCS = 1_500_000, 1 << 15
#: Rounds; Gibbs sweeps of a round, and those of them that are not averaged.
ROUNDS, SWEEPS, BURN_IN = 3, 5, 2
#: Customers up to which the tables of a dish are drawn from their exact conditional.
EXACT = 64
#: Customers up to which the weights of numbers of tables are far from the limits of a double, so no logarithms are taken.
DIRECT = 16
#: Values that discount and strength are drawn from.
DISCOUNTS = np.arange(1, 20) / 20
STRENGTHS = np.array([0.1, 0.5, 2.0, 8.0, 32.0, 128.0, 512.0])
END = b"\n"
SEED = 7


class Stirling:
    """Log of the generalised Stirling numbers S(c, t), weights of c customers at t tables, for each discount asked for.

    Discounts are those of the grid, so there are few. Tables stay where they were made: a task makes its own.
    """

    def __init__(self, top: int = EXACT):
        self.top, self.held = top, {}

    def __getstate__(self) -> dict:
        return {"top": self.top, "held": {}}

    def __call__(self, d: float) -> np.ndarray:
        if d not in self.held:
            out = np.full((self.top + 1, self.top + 1), -np.inf)
            out[0, 0] = 0.0
            for c in range(1, self.top + 1):
                t = np.arange(1, c + 1)
                stay = out[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - d * t, 1e-300))
                out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], stay)
            self.held[d] = out
        return self.held[d]


stirling = Stirling()


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, d: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw the number of tables of each dish, given its customers and the tables of all other dishes.

    Up to ``EXACT`` customers the draw is from the conditional: t tables weigh S(c, t) times the
    chances to open them, (strength + d * (others + j)) * parent for j below t. Further customers
    enter in blocks of a tenth of those seated, at the chance of a new table that holds there.
    """
    out = np.ones(len(customers), np.int64)
    first = np.minimum(customers, EXACT)
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(2, EXACT + 2))
    for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), start=2):
        step = max(1, (1 << 20) // c)
        for at in range(a, b, step):
            rows = order[at : min(b, at + step)]
            if c <= DIRECT:
                base, up, weight, own = strength + d * others[rows], parent[rows], 1.0, np.exp(table[c])
                sums = np.empty((c, len(rows)))
                sums[0] = own[1]  # the first table is opened in any case
                for j in range(1, c):
                    weight = weight * ((base + d * j) * up)
                    sums[j] = sums[j - 1] + weight * own[j + 1]
                out[rows] = 1 + (sums < rng.random(len(rows)) * sums[-1]).sum(axis=0)
                continue
            open_ = np.log((strength + d * (others[rows, None] + np.arange(c))) * parent[rows, None])
            logit = np.cumsum(open_, axis=1) + table[c, 1 : c + 1]
            chance = np.exp(logit - logit.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[rows] = 1 + (chance < rng.random(len(rows))[:, None] * chance[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(customers > EXACT)
    seated = np.full(len(rows), EXACT, np.int64)
    while len(rows):
        block = np.minimum(np.maximum(seated // 10, 1), customers[rows] - seated)
        pull = (strength + d * (others[rows] + out[rows])) * parent[rows]
        out[rows] += rng.binomial(block, pull / (pull + np.maximum(seated + block / 2 - d * out[rows], 1e-9)))
        seated = seated + block
        go = seated < customers[rows]
        rows, seated = rows[go], seated[go]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for positive numbers, by Stirling's series after a shift."""
    x = np.asarray(x, np.float64)
    low = np.maximum(x, 1e-300)
    shift = np.zeros_like(low)
    for _ in range(8):
        small = low < 8
        shift = shift - np.where(small, np.log(low), 0.0)
        low = np.where(small, low + 1, low)
    return shift + (low - 0.5) * np.log(low) - low + 0.9189385332046727 + 1 / (12 * low) - 1 / (360 * low**3)


def room_weights(tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """Log weights, on the grid, of how many tables restaurants of so many customers have."""
    if not len(tables):
        return np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    both, n = np.unique(tables + 1j * customers, return_counts=True)  # most restaurants are small and alike
    t, c = both.real, both.imag
    seated = np.stack([log_gamma(y + c) - log_gamma(np.array(y + 1)) for y in STRENGTHS])

    def opened(x: float, y: float) -> np.ndarray:
        return (t - 1) * np.log(x) + log_gamma(y / x + t) - log_gamma(np.array(y / x + 1))

    return np.array([[(n * (opened(x, y) - seated[j])).sum() for j, y in enumerate(STRENGTHS)] for x in DISCOUNTS])


class Seating(NamedTuple):
    """What a seating says about strength and discount, in numbers that can be added up."""

    pairs: np.ndarray  # dishes by customers and tables, up to EXACT customers
    large: np.ndarray  # of the other dishes: their number, log customers, tables but one

    @classmethod
    def of(cls, customers: np.ndarray, tables: np.ndarray, weight: np.ndarray | None = None) -> Seating:
        few = customers <= EXACT
        pairs = np.bincount(customers[few] * (EXACT + 1) + tables[few], None if weight is None else weight[few], minlength=(EXACT + 1) ** 2)
        c, t, w = customers[~few], tables[~few], 1.0 if weight is None else weight[~few]
        return cls(pairs, np.array([(np.ones(len(c)) * w).sum(), (np.log(c) * w).sum(), ((t - 1) * w).sum()], np.float64))

    def weights(self) -> np.ndarray:
        """Log weights of the tables of all dishes for each discount: S(c, t), and its limit for large c."""
        at, (n, logs, more) = np.flatnonzero(self.pairs), self.large
        own = [(stirling(float(d)).ravel()[at] * self.pairs[at]).sum() for d in DISCOUNTS]
        return (own - n * log_gamma(1 - DISCOUNTS) - DISCOUNTS * logs - more * np.log(DISCOUNTS))[:, None]


def draw_parameters(weights: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength from their log weights on the grid."""
    chance = np.exp(weights.ravel() - weights.max()).cumsum()
    i = int(np.searchsorted(chance, rng.random() * chance[-1]))
    return float(DISCOUNTS[i // len(STRENGTHS)]), float(STRENGTHS[i % len(STRENGTHS)])


class Rooms(NamedTuple):
    """Averaged seating of a bucket's dishes: their context, tables, and those of the last sweep."""

    contexts: np.ndarray
    room: np.ndarray
    tables: np.ndarray
    last: np.ndarray


def sweep_rooms(context: np.ndarray, dish: np.ndarray, customers: np.ndarray, totals: np.ndarray, parent: np.ndarray, d: float, strength: float, sweeps: int, burn_in: int, rng: np.random.Generator) -> Rooms:
    """Gibbs sweeps over restaurants whose dishes are sorted by context.

    ``totals`` has the customers of every context; where only a piece of a restaurant is here (chosen
    by a hash of the dish), its tables are scaled up to the whole.
    """
    contexts, room = np.unique(context, return_inverse=True)
    scale = totals[contexts] / np.maximum(np.bincount(room, customers, len(contexts)), 1)
    tables, sums = np.ones(len(customers), np.int64), np.zeros(len(customers))
    many = np.flatnonzero(customers > 1)
    tables[many] = np.maximum(1, customers[many] ** d).astype(np.int64)
    up, numbers = parent[dish[many]], stirling(d)
    for sweep in range(sweeps):
        others = np.maximum((np.bincount(room, tables, len(contexts)) * scale)[room[many]] - tables[many], 0)
        tables[many] = seat(customers[many], others, up, strength, d, numbers, rng)
        if sweep >= burn_in:
            sums += tables
    return Rooms(contexts, room, sums / (sweeps - burn_in), tables)


class Parent(NamedTuple):
    """The restaurant of words without context. All have one base, so a word's chance depends on its customers alone."""

    counts: np.ndarray
    chance: np.ndarray
    unknown: float

    @classmethod
    def first(cls, counts: np.ndarray, kinds: np.ndarray) -> Parent:
        """A start before any sweep: ``kinds`` words have ``counts`` customers."""
        total, even = float((counts * kinds).sum()), 0.5 / max(kinds.sum(), 1)
        return cls(counts, (counts + even) / (total + 1), (0.5 if len(counts) else 1.0) / (total + 1))

    @classmethod
    def fit(cls, counts: np.ndarray, kinds: np.ndarray, rng: np.random.Generator, sweeps: int, burn_in: int) -> Parent:
        """Averaged chances; strength and discount are drawn in every sweep. Half of the base goes to words that training lacks."""
        if not len(counts):
            return cls.first(counts, kinds)
        some = np.minimum(kinds, 1000)  # words of one count are alike: their draws are weighted
        which, weight = np.repeat(np.arange(len(counts)), some), np.repeat(kinds / some, some)
        total, even, d, strength = float((counts * kinds).sum()), 0.5 / kinds.sum(), 0.5, 1.0
        customers, up = counts[which], np.full(len(which), even)
        tables, chance, unknown = np.ones(len(which), np.int64), np.zeros(len(counts)), 0.0
        for sweep in range(sweeps):
            tables = seat(customers, (tables * weight).sum() - tables, up, strength, d, stirling(d), rng)
            opened = float((tables * weight).sum())
            d, strength = draw_parameters(Seating.of(customers, tables, weight).weights() + room_weights(np.array([opened]), np.array([total])), rng)
            if sweep >= burn_in:
                mean = np.bincount(which, tables, len(counts)) / some
                chance += (counts - d * mean + (strength + d * opened) * even) / (strength + total)
                unknown += (strength + d * opened) / (strength + total) / 2
        return cls(counts, chance / (sweeps - burn_in), unknown / (sweeps - burn_in))

    def of(self, n: np.ndarray) -> np.ndarray:
        """Chance of words with so many customers; 0 for those that training lacks."""
        if not len(self.counts):
            return np.full(len(n), self.unknown)
        return np.where(n > 0, self.chance[np.minimum(np.searchsorted(self.counts, n), len(self.counts) - 1)], self.unknown)


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, first bytes of all numbers first, compressed."""
    b = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype) -> np.ndarray:
    size, raw = int.from_bytes(b[:8], "little"), memoryview(b)[8:]
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(dtype).ravel() if size else np.zeros(0, dtype)


def steps(a: np.ndarray) -> bytes:
    """A rising array, packed by its steps."""
    return packed(np.diff(a, prepend=a.dtype.type(0)))


def risen(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpacked(b, dtype), dtype=dtype)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. A stable sort merges lists that are sorted already."""
    a = np.sort(a, kind="stable")
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of names, which are evenly spread; ``range_column`` is the same of a column."""
    return ((names >> 32) * ranges) >> 31


def range_column(name: str, ranges: int):
    return F.shiftright(F.shiftright(name, 32) * F.lit(ranges).cast("long"), 31)


class Words(dict):
    """Numbers of frequent words; any other word's is negative and made of 63 bits of a hash, its name."""

    def __missing__(self, word: bytes) -> int:
        return -1 - (xxhash.xxh64_intdigest(word) >> 1)


class Plan(NamedTuple):
    """What every task knows: the numbers of frequent words, their counts, and how contexts are dealt."""

    words: Words
    counts: np.ndarray  # by number; then the starts of documents
    pieces: np.ndarray  # of each context
    buckets: int
    rare_buckets: int
    total: int
    kinds: int

    @property
    def ranges(self) -> int:
        """Ranges of names: a task that adds up what is known of one holds a few million names at most."""
        return -(-self.rare_buckets // 4)

    @property
    def start(self) -> int:
        return len(self.counts) - 1

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.kinds + 1)))

    def bucket_of(self, context: np.ndarray, dish: np.ndarray) -> np.ndarray:
        """Buckets of pairs, by number or, if negative, by name."""
        piece = mixed(dish) % np.where(context < 0, 1, self.pieces[np.maximum(context, 0)]).astype(np.uint64)
        return (mixed(mixed(context).view(np.int64) + piece.astype(np.int64)) % np.uint64(self.buckets)).astype(np.int64)

    def local(self, codes: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Numbers within a chunk: names go on after the numbered words."""
        out, at = codes.copy(), np.flatnonzero(codes < 0)
        out[at] = len(self.counts) + np.searchsorted(names, -1 - codes[at])
        return out

    def totals(self, keys: np.ndarray, counts: np.ndarray, names: int) -> np.ndarray:
        """Customers of each context; a named one is whole in its bucket."""
        context, first = keys >> BITS, len(self.counts)
        own = context >= first
        return np.r_[self.counts, np.bincount(context[own] - first, counts[own], names).astype(np.int64)]


def mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


POSTINGS = "kind int, bucket long, first long, names binary, keys binary, per binary, doc binary, times binary"
POSTINGS_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("first", pa.int64()), ("names", pa.binary()), ("keys", pa.binary()), ("per", pa.binary()), ("doc", pa.binary()), ("times", pa.binary())])


def renamed(keys: np.ndarray, base: int, new: np.ndarray) -> np.ndarray:
    """Keys with other numbers for names, which go on after ``base``; ``new`` rises, so the keys' order stays."""
    both = [keys >> BITS, keys & ((1 << BITS) - 1)]
    for x in both:
        at = np.flatnonzero(x >= base)
        x[at] = base + new[x[at] - base]
    return (both[0] << BITS) | both[1]


def names_in(keys: np.ndarray, base: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names that keys hold, and the keys with numbers for these alone."""
    held = np.zeros(len(names), bool)
    for x in (keys >> BITS, keys & ((1 << BITS) - 1)):
        held[x[x >= base] - base] = True
    return names[held], renamed(keys, base, np.cumsum(held) - 1)


def postings(kind: int, first: int, bucket: np.ndarray, key: np.ndarray, order: np.ndarray, doc: np.ndarray, base: int = 0, names: np.ndarray | None = None) -> Iterator[tuple]:
    """A row for each bucket: its distinct keys, in how many documents each stands, which, and how often."""
    bucket, key, doc = bucket[order], key[order], doc[order]
    new_key = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]
    new = np.flatnonzero(new_key | np.r_[True, doc[1:] != doc[:-1]])
    times, keys_at = np.diff(np.r_[new, len(key)]), np.flatnonzero(new_key[new])
    per = np.diff(np.r_[keys_at, len(new)])
    owner = bucket[new[keys_at]]
    cuts = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
    ends = np.r_[keys_at, len(new)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = ends[a], ends[b]
        own, keys = (b"", key[new[keys_at[a:b]]]) if names is None else names_in(key[new[keys_at[a:b]]], base, names)
        yield kind, int(owner[a]), first, own if names is None else steps(own), steps(keys.astype(np.uint64)), packed(per[a:b].astype(np.uint16)), packed(doc[new[x:y]].astype(np.uint16)), packed(times[x:y].astype(np.uint32))


def pack_documents(docs: DataFrame, plan: Shipped) -> DataFrame:
    """Occurrences of ``(doc, text, held)`` as ``POSTINGS``: kind 1 word pairs, 2 named words, 0 the documents.

    ``first`` names the chunk, and documents are counted in it; one that goes on in the next chunk is
    in both, under one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Plan = plan.value
        number, words, start = (TaskContext.get().partitionId() << 40) - 1, own.words, own.start
        parts: list = []
        rows_of: dict = {}
        held_tokens, chunk = 0, number

        def emit() -> pa.RecordBatch:
            codes = np.concatenate([c for _, c, _ in parts])
            first, lead = chunk, parts[0][0]
            doc = np.repeat([(n - lead) * 2 + rows_of[n][1] for n, _, _ in parts], [len(c) for _, c, _ in parts])
            starts, before = np.cumsum([0, *[len(c) for _, c, _ in parts[:-1]]]), np.array([p for _, _, p in parts], np.int64)
            names = distinct(-1 - np.r_[codes[codes < 0], before[before < 0]])
            ids = own.local(codes, names)
            context, previous_ids = np.r_[0, codes[:-1]], np.r_[0, ids[:-1]]
            context[starts], previous_ids[starts] = before, own.local(before, names)
            bucket, key = own.bucket_of(context, codes), (previous_ids << BITS) | ids
            order = np.argsort(key, kind="stable")
            near = bucket[order].astype(np.uint16 if own.buckets <= 1 << 16 else np.int64)  # short numbers sort in linear time
            out = list(postings(1, first, bucket, key, order[np.argsort(near, kind="stable")], doc, len(own.counts), names))
            at = np.flatnonzero(codes < 0)
            if len(at):
                key = -1 - codes[at]
                out += postings(2, first, range_of(key, own.rare_buckets), key, np.argsort(key, kind="stable"), doc[at])
            numbers = np.array(sorted(rows_of), np.int64)
            sizes = np.bincount((doc >> 1), minlength=len(numbers))
            known = np.bincount(doc >> 1, codes >= 0, len(numbers)).astype(np.int64)
            base = np.bincount(doc >> 1, np.where(codes >= 0, own.base(own.counts[np.maximum(codes, 0)]), 0.0), len(numbers))
            flags = np.array([rows_of[n][1] + 2 * (rows_of[n][0] is None) for n in numbers], np.uint8)
            docs_ = np.array([rows_of[n][0] or 0 for n in numbers], np.int64)
            out.append((0, int(mixed(np.array([first]))[0] >> np.uint64(1)), first, b"", packed(docs_), packed(flags), packed(np.concatenate([sizes, known, [lead]])), packed(base)))
            return record_batch(POSTINGS_ARROW, list(zip(*out, strict=True)))

        for batch in batches:
            for doc, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number += 1
                previous = start
                tokens = words_of(as_bytes(text).lower(), 1 << 22)
                for some in _ended(tokens):
                    if parts and (held_tokens + len(some) > CHUNK or len(rows_of) >= CHUNK_DOCS):
                        chunk += 1
                        yield emit()
                        parts, rows_of, held_tokens = [], {}, 0
                    codes = np.fromiter(map(words.__getitem__, some), np.int64, len(some))
                    parts.append((number, codes, previous))
                    rows_of[number] = (doc, int(held))
                    held_tokens += len(codes)
                    previous = int(codes[-1])
        if parts:
            chunk += 1
            yield emit()

    return docs.mapInArrow(run, POSTINGS)


def _ended(lists: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
    """The lists of words, with the end of the document in the last."""
    held = None
    for words in lists:
        if held:
            yield held
        held = words
    yield [*(held or []), END]


def gather_rooms(packed_docs: DataFrame, base: int) -> DataFrame:
    """A row for each bucket: sorted names, sorted keys (with names numbered from ``base``), how often training has each, and the documents' lists as they came."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("names", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("first", pa.list_(pa.int64())), ("at", pa.list_(pa.binary())), ("per", pa.list_(pa.binary())), ("doc", pa.list_(pa.binary())), ("times", pa.list_(pa.binary()))])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        group = group.sort_by("first")
        first, names, keys, per, doc, times = (group.column(n).to_pylist() for n in ("first", "names", "keys", "per", "doc", "times"))
        if kind == 0:
            return pa.Table.from_pylist([{"kind": 0, "bucket": bucket, "names": b"", "keys": b"", "counts": b"", "first": first, "at": keys, "per": per, "doc": doc, "times": times}], schema=schema)
        own, united = [risen(k, np.uint64) for k in keys], np.zeros(0, np.int64)
        if kind == 1:
            lists = [risen(n, np.int64) for n in names]
            united = distinct(np.concatenate(lists))
            own = [renamed(k.astype(np.int64), base, np.searchsorted(united, n)).astype(np.uint64) for k, n in zip(own, lists, strict=True)]
        merged = distinct(np.concatenate(own))
        counts, at = np.zeros(len(merged), np.int64), []
        for k, p, d, t in zip(own, per, doc, times, strict=True):
            where = np.searchsorted(merged, k)
            trained = np.where(unpacked(d, np.uint16) & 1, 0, unpacked(t, np.uint32)).astype(np.int64)
            counts[where] += np.add.reduceat(trained, np.r_[0, np.cumsum(unpacked(p, np.uint16), dtype=np.int64)[:-1]])
            at.append(steps(where.astype(np.uint32)))
        row = {"kind": kind, "bucket": bucket, "names": steps(united), "keys": steps(merged), "counts": packed(counts), "first": first, "at": at, "per": per, "doc": doc, "times": times}
        return pa.Table.from_pylist([row], schema=schema)

    ddl = "kind int, bucket long, names binary, keys binary, counts binary, first array<long>, at array<binary>, per array<binary>, doc array<binary>, times array<binary>"
    return packed_docs.groupBy("kind", "bucket").applyInArrow(run, ddl)


class Round(NamedTuple):
    """What the tasks of one round are given."""

    number: int
    parent: Parent
    top: np.ndarray  # chances of the numbered words
    d: float
    strength: float
    sweeps: int
    burn_in: int
    seed: int


class Bucket(NamedTuple):
    """A bucket after the round's sweeps; its names are numbered after the words that every task knows."""

    keys: np.ndarray
    seen: np.ndarray  # where keys have customers
    customers: np.ndarray
    rooms: Rooms
    totals: np.ndarray  # customers of each context
    pieces: np.ndarray
    parent: np.ndarray


def swept(own: Plan, now: Round, bucket: int, keys: np.ndarray, counts: np.ndarray, held: np.ndarray) -> Bucket:
    """Sweep over a bucket; ``held`` has the parent's customers for each of its names."""
    seen, all_keys = np.flatnonzero(counts), keys.astype(np.int64)
    key, customers = all_keys[seen], counts[seen]
    totals, parent = own.totals(key, customers, len(held)), np.r_[now.top, 0.0, now.parent.of(held)]
    rng = np.random.Generator(np.random.PCG64([now.seed, now.number, bucket]))
    rooms = sweep_rooms(key >> BITS, key & ((1 << BITS) - 1), customers, totals, parent, now.d, now.strength, now.sweeps, now.burn_in, rng)
    return Bucket(all_keys, seen, customers, rooms, totals, np.r_[own.pieces, np.ones(len(held), np.int64)], parent)


def members_of(rooms: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``(part, bucket, names)``: the names in every bucket, packed by range."""
    schema = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(part, bucket, steps(own)) for part, own in by_part(risen(names, np.int64), ranges)]
                if rows:
                    yield record_batch(schema, list(zip(*rows, strict=True)))

    return rooms.where("kind = 1").select("bucket", "names").mapInArrow(run, "part long, bucket long, names binary")


def by_part(names: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted names, cut into their ranges."""
    part = range_of(names, ranges)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(part[cuts].tolist(), np.split(names, cuts[1:]) if len(cuts) else [], strict=True)


def named_counts(rooms: DataFrame) -> DataFrame:
    """``(name, n)``: how often training has each named word."""
    schema = pa.schema([("name", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield record_batch(schema, (risen(keys, np.uint64).astype(np.int64), unpacked(counts, np.int64)))

    return rooms.where("kind = 2").select("keys", "counts").mapInArrow(run, "name long, n long").where("n > 0")


def customers_of(members: DataFrame, tables: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``(kind, bucket, held)``: the parent's customers ``(name, n)`` of each of a bucket's names, packed in their order.

    Words meet by range, with a row for each bucket that holds some; no row stands for a word in a bucket.
    """
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("held", pa.binary())])
    result = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("held", pa.binary())])

    def meet(key: tuple, members: pa.Table, tables: pa.Table) -> pa.Table:
        name, n = (tables.column(c).to_numpy() for c in ("name", "n"))
        order = np.argsort(name, kind="stable")
        name, n = np.r_[name[order], -1], np.r_[n[order], 0]
        rows = []
        for bucket, names in zip(*(members.column(c).to_pylist() for c in ("bucket", "names")), strict=True):
            own = risen(names, np.int64)
            at = np.searchsorted(name[:-1], own)
            rows.append({"bucket": bucket, "part": key[0].as_py(), "held": packed(np.where(name[at] == own, n[at], 0).astype(np.int64))})
        return pa.Table.from_pylist(rows, schema=schema)

    def join(key: tuple, group: pa.Table) -> pa.Table:
        parts = [unpacked(x, np.int64) for x in group.sort_by("part").column("held").to_pylist()]
        return pa.Table.from_pylist([{"kind": 1, "bucket": key[0].as_py(), "held": packed(np.concatenate(parts))}], schema=result)

    known = tables.select(range_column("name", ranges).alias("part"), "name", "n")
    found = members.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(meet, "bucket long, part long, held binary")
    return found.groupBy("bucket").applyInArrow(join, "kind int, bucket long, held binary")


def dealt(rooms: DataFrame, members: DataFrame, tables: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``rooms`` with ``held`` of ``customers_of``."""
    return rooms.join(customers_of(members, tables, ranges), ["kind", "bucket"], "left")


def added_up(found: DataFrame) -> DataFrame:
    """``(what, key, value)``: values of equal keys in ``(what, part, keys, values)``, packed, added up."""
    schema = pa.schema([("what", pa.int32()), ("key", pa.int64()), ("value", pa.float64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("keys", "ascending"), ("values", "ascending")])  # one order of summation
        keys = np.concatenate([risen(k, np.int64) for k in group.column("keys").to_pylist()])
        values = np.concatenate([unpacked(v, np.float64) for v in group.column("values").to_pylist()])
        every = distinct(keys)
        sums = np.bincount(np.searchsorted(every, keys), values, len(every))
        return pa.Table.from_arrays([pa.array(np.full(len(every), key[0].as_py(), np.int32)), pa.array(every), pa.array(sums)], schema=schema)

    return found.groupBy("what", "part").applyInArrow(run, "what int, key long, value double")


def run_round(rooms: DataFrame, plan: Shipped, now: Round) -> tuple[np.ndarray, DataFrame, dict[int, float], np.ndarray]:
    """Tables of each numbered dish and, ``(name, n)``, of each named one; averaged tables of the contexts that are
    cut into pieces, and the grid's log weights.

    What comes to the driver is bounded by the numbered words, whatever the size of the corpus.
    """
    grid = len(DISCOUNTS) * len(STRENGTHS)
    shipped = Shipped(rooms.sparkSession, now)
    schema = pa.schema([("what", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])

    def row(what: int, part: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return record_batch(schema, ([what], [part], [steps(keys)], [packed(values)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Plan = plan.value
        first = len(own.counts)
        tables, pairs, large, weights, cut = np.zeros(first), 0, np.zeros(3), np.zeros(grid), Counter()
        for batch in batches:
            for bucket, names, keys, counts, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = risen(names, np.int64)
                b = swept(own, shipped.value, bucket, risen(keys, np.uint64), unpacked(counts, np.int64), unpacked(held or b"", np.int64))
                got = b.rooms
                opened = np.bincount(b.keys[b.seen] & ((1 << BITS) - 1), got.last, first + len(names))
                tables += opened[:first]
                at = np.flatnonzero(opened[first:])
                done = 0
                for part, some in by_part(names[at], own.ranges):
                    yield row(5, part, some, opened[first + at[done : done + len(some)]])
                    done += len(some)
                seated = Seating.of(b.customers, got.last)
                pairs, large = pairs + seated.pairs, large + seated.large
                here, mean = (np.bincount(got.room, x, len(got.contexts)) for x in (got.last, got.tables))
                whole = b.pieces[got.contexts] == 1
                for u, t in zip(got.contexts[~whole].tolist(), mean[~whole].tolist(), strict=True):
                    cut[u] += t
                weights += room_weights(here[whole], b.totals[got.contexts][whole]).ravel()
        several = np.array(sorted(cut), np.int64)
        sums = [(x, np.flatnonzero(a), a[a != 0]) for x, a in enumerate((tables, pairs + np.zeros((EXACT + 1) ** 2), np.round(large, 3), np.round(weights, 3)))]
        for what, at, a in [*sums, (4, several, np.array([cut[u] for u in several.tolist()], np.float64))]:
            for lo in np.unique(at // BLOCK).tolist():
                here = at // BLOCK == lo
                yield row(what, lo, at[here], a[here])

    with batch_rows(rooms.sparkSession, 4):
        found = stored(added_up(rooms.where("kind = 1").select("bucket", "names", "keys", "counts", "held").mapInArrow(run, "what int, part long, keys binary, values binary")))
    sums = found.where("what < 5").toArrow()
    what, key, value = (sums.column(i).to_numpy() for i in range(3))
    own: Plan = plan.local

    def vector(i: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[key[what == i]] = value[what == i]
        return out

    held = Seating(vector(1, (EXACT + 1) ** 2), vector(2, 3))
    cut = dict(zip(key[what == 4].tolist(), value[what == 4].tolist(), strict=True))
    whole = room_weights(np.maximum(np.array(list(cut.values())), 1), own.counts[list(cut)]) if cut else 0.0
    named = found.where("what = 5").select(F.col("key").alias("name"), F.col("value").cast("long").alias("n"))
    return vector(0, own.start).astype(np.int64), named, cut, held.weights() + vector(3, grid).reshape(len(DISCOUNTS), -1) + whole


def alike(numbered: np.ndarray, named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many words (second) have as many customers (first); at most sqrt(2 * total) counts of named words."""
    rows = named.groupBy("n").count().collect()
    counts, where = np.unique(np.r_[numbered, np.array([r[0] for r in rows], np.int64)], return_inverse=True)
    return counts, np.bincount(where, np.r_[np.ones(len(numbered)), [r[1] for r in rows]], len(counts)).astype(np.int64)


def chances(now: Round, cut: dict[int, float], b: Bucket) -> np.ndarray:
    """Averaged probability of each key's word after its context."""
    contexts, room = np.unique(b.keys >> BITS, return_inverse=True)
    tables, got = np.zeros(len(contexts)), b.rooms
    tables[np.searchsorted(contexts, got.contexts)] = np.bincount(got.room, got.tables, len(got.contexts))
    for i in np.flatnonzero(b.pieces[contexts] > 1).tolist():
        tables[i] = cut.get(int(contexts[i]), 0.0)
    total = now.strength + b.totals[contexts]
    out = ((now.strength + now.d * tables) / total)[room] * b.parent[b.keys & ((1 << BITS) - 1)]
    out[b.seen] += (b.customers - now.d * got.tables) / total[room[b.seen]]
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over the training documents ``(text)``, an end for each document."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in words_of(as_bytes(text).lower()):
                    tally.update(words)
                tally[END] += 1
            if len(tally) > 1_000_000:  # memory stays bounded; the rest is added up by Spark
                yield record_batch(schema, (list(tally), list(tally.values())))
                tally.clear()
        yield record_batch(schema, (list(tally), list(tally.values())))

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def make_plan(words: DataFrame, documents: int, share: int = SHARE, bucket: int = BUCKET) -> Plan:
    """The plan. ``share`` and ``bucket`` say where words and pairs are kept, not how they are modelled."""
    kinds, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = -(-total // (1 << share))
    top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()  # at most 2 ** share words
    names, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64)
    numbered = np.r_[n, documents].astype(np.int64)
    return Plan(Words(zip(names, range(len(names)), strict=True)), numbered, np.maximum(1, -(-8 * numbered // bucket)), max(1, -(-total // bucket)), max(1, -(-4 * (total - int(n.sum())) // bucket)), total, kinds)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 1, rounds: int = ROUNDS, sweeps: int = SWEEPS, burn_in: int = BURN_IN, share: int = SHARE, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)``.

    Learns from the rows whose ``crc32(id as text)`` modulo ``folds`` is not ``held_out_fold``. Tokens
    are the words (A-Z lowered, ASCII white space) and an end for each document. ``base_score`` is the
    log10 probability under the smoothed unigram, ``score`` that under the sampled model: each token
    given the word before it. Both have the same outcomes: each token of training, and one for all
    others. The result depends on the rows, not on how they are partitioned.

    Null text: empty, one end. Null id: scored, not held out, not learned from. Repeated rows: each
    counts and returns. Very long texts are taken in pieces of bounded size; a word goes on from one
    to the next. Empty table: empty result. If nothing is left to learn from, V and N are 0 and every
    word is unknown. Ties do not occur. Other columns are ignored.
    """
    spark = docs.sparkSession
    fold = fold_of(id_col, folds)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).isNull() | (fold == held_out_fold), F.lit(True)).alias("skip"))
    words = stored(count_words(docs.where("not skip").select("text")))
    documents = docs.where("not skip").count()
    own = make_plan(words, documents, share, bucket)
    plan = Shipped(spark, own)
    with batch_rows(spark, 1000):
        rooms = stored(gather_rooms(pack_documents(docs, plan), len(own.counts)))

    def held_by(named: DataFrame) -> DataFrame:
        with batch_rows(spark, 20_000):  # names, not texts
            return stored(customers_of(members, named, own.ranges))

    rng = np.random.Generator(np.random.PCG64(seed))
    with batch_rows(spark, 4):
        members = stored(members_of(rooms, own.ranges))
    top, named = own.counts[:-1], stored(named_counts(rooms))
    parent, d, strength = Parent.first(*alike(top, named)), 0.75, 2.0
    for r in range(rounds):
        now = Round(r, parent, parent.of(top), d, strength, sweeps, burn_in, seed)
        before = held_by(named)
        top, named, cut, weights = run_round(rooms.select("kind", "bucket", "names", "keys", "counts").where("kind = 1").join(before, ["kind", "bucket"], "left"), plan, now)
        d, strength = draw_parameters(weights, rng)
        parent = Parent.fit(*alike(top, named), rng, 2 * sweeps, 2 * burn_in)
    last = Shipped(spark, (now, cut, parent, parent.of(top)))
    partial = pa.schema([("first", pa.int64()), ("kind", pa.int32()), ("doc", pa.binary()), ("sums", pa.binary())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for the documents of each chunk, over all buckets of a task: ``doc`` numbers them in the chunk."""
        mine: Plan = plan.value
        final, pieces, latest, chance = last.value
        found: dict[int, list] = {}
        size = 0

        def emit() -> pa.RecordBatch:
            rows = []
            for first, parts in found.items():
                doc, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = [np.bincount(where, np.concatenate([p[i] for p in parts]), len(doc)) for i in (1, 2, 3)]
                rows.append((first, 1, steps(doc), packed(np.concatenate(sums))))
            return record_batch(partial, list(zip(*rows, strict=True)))

        for batch in batches:
            for kind, bucket_, keys, counts, firsts, held, later, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    for first, ids, flags, numbers, b in zip(firsts, *lists, strict=True):
                        more = np.concatenate([unpacked(ids, np.int64), unpacked(b, np.float64).view(np.int64), unpacked(numbers, np.int64)])
                        yield record_batch(partial, ([first], [0], [flags], [packed(more)]))
                    continue
                keys, counts = risen(keys, np.uint64), unpacked(counts, np.int64)
                if kind == 1:
                    room = swept(mine, final, bucket_, keys, counts, unpacked(held or b"", np.int64))
                    parent_ = np.r_[chance, 0.0, latest.of(unpacked(later or b"", np.int64))]
                    value, b, known = np.log10(chances(final, pieces, room._replace(parent=parent_))), None, None
                else:
                    value, b, known = None, mine.base(counts), counts > 0
                for first, at, per, doc, times in zip(firsts, *lists, strict=True):
                    at = np.repeat(risen(at, np.uint32), unpacked(per, np.uint16))
                    rows, where = np.unique(unpacked(doc, np.uint16) >> 1, return_inverse=True)
                    times = unpacked(times, np.uint32).astype(np.float64)
                    add = lambda x: np.bincount(where, x[at] * times, len(rows)) if x is not None else np.zeros(len(rows))  # noqa: E731, B023
                    found.setdefault(first, []).append((rows.astype(np.int64), add(known), add(b), add(value)))
                    size += len(rows)
                if size > 2_000_000:
                    yield emit()
                    found, size = {}, 0
        if found:
            yield emit()

    result = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("flags", pa.int32()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def total(group: pa.Table) -> pa.Table:
        """The documents of a chunk, with the sums of all buckets: at most one number for each of its tokens."""
        group = group.sort_by([("kind", "ascending"), ("sums", "ascending")])  # one order of summation
        kind, doc, sums = (group.column(n).to_pylist() for n in ("kind", "doc", "sums"))
        flags, (*more, lead) = unpacked(doc[0], np.uint8), unpacked(sums[0], np.int64)
        ids, base, tokens, known = np.array(more, np.int64).reshape(4, -1)
        added = np.stack([known.astype(np.float64), base.view(np.float64), np.zeros(len(flags))])
        for d, x in zip(doc[1:], sums[1:], strict=True):
            added[:, risen(d, np.int64)] += unpacked(x, np.float64).reshape(3, -1)
        return pa.Table.from_arrays([pa.array(lead + np.arange(len(flags))), pa.array(ids, mask=flags > 1), pa.array((flags & 1).astype(np.int32)), pa.array(tokens), pa.array(added[0].astype(np.int64)), pa.array(added[1]), pa.array(added[2])], schema=result)

    known = before.withColumnRenamed("held", "earlier").join(held_by(named), ["kind", "bucket"])
    with batch_rows(spark, 4):
        both = rooms.join(known, ["kind", "bucket"], "left")
        parts = both.select("kind", "bucket", "keys", "counts", "first", "earlier", "held", "at", "per", "doc", "times").mapInArrow(score, "first long, kind int, doc binary, sums binary")
        chunks = parts.groupBy("first").applyInArrow(total, "row long, doc long, flags int, tokens long, known long, base double, model double")
        # A document that goes on in another chunk has a row in each.
        sums = chunks.groupBy("row").agg(F.max("doc").alias("doc_id"), F.max("flags").alias("flags"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"))
        sums = stored(sums)
    held = (F.col("flags") == 1) & F.col("doc_id").isNotNull()
    return sums.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(own.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
