"""A quality classifier: an additive model of lookup tables with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, as_bytes, fold_of, record_batch, small_batches, stored

FEATURES = ("chars", "words", "word_length", "distinct_words", "repeated_neighbours", "top_word", "upper", "digits", "marks", "symbols", "bangs", "stops", "commas", "bars", "non_ascii", "newlines", "distinct_lines", "line_length", "capital_words", "short_words")
#: Labelled rows that the fit may use at most: those with the smallest hash of their id.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, RATE, LEAVES, RIDGE = 200, 0.1, 3, 5.0
#: Rounds without a better loss on the rows set aside, after which a fit stops.
PATIENCE = 20

_UPPER, _DIGIT, _HIGH = (np.isin(np.arange(256), x) for x in (np.arange(65, 91), np.arange(48, 58), np.arange(128, 256)))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@^_~{}[]\\/", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!\"'(),-.:;?", np.uint8))


def measure(text: str | None) -> tuple[float, ...]:
    """The features of a whole text, in the order of ``FEATURES``; an empty text gives zeros."""
    data = as_bytes(text)
    if not data:
        return (0.0,) * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = len(data), data.split(), data.split(b"\n")
    share = lambda x: float(count[x].sum()) / n
    kinds = Counter(words)
    m = max(len(words), 1)
    return (
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        (n - int(count[[32, 9, 10, 11, 12, 13]].sum())) / m,
        len(kinds) / m,
        sum(map(eq, words, words[1:])) / m,
        max(kinds.values(), default=0) / m,
        share(_UPPER),
        share(_DIGIT),
        share(_MARK),
        share(_SYMBOL),
        count[33] / n,
        count[46] / n,
        count[44] / n,
        count[124] / n,
        share(_HIGH),
        count[10] / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(times for w, times in kinds.items() if 65 <= w[0] <= 90) / m,
        sum(times for w, times in kinds.items() if len(w) <= 2) / m,
    )


class Additive(NamedTuple):
    """Bin edges of each feature, a lookup table for each, and a table for each pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[j]]
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> tuple[np.ndarray, float]:
    """Leaf values of each bin, and the gain: split the run of bins with the largest gain, again and again."""
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    cg, ch = np.r_[0.0, g.cumsum()], np.r_[0.0, h.cumsum()]
    runs, gained = [(0, len(g))], 0.0
    while len(runs) < leaves:
        best = (1e-12, None, 0)
        for r, (a, b) in enumerate(runs):
            if b - a < 2:
                continue
            cuts = np.arange(a + 1, b)
            gain = value(a, cuts) + value(cuts, b) - value(a, b)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), r, int(cuts[k]))
        if best[1] is None:
            break
        gained += best[0]
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out, gained


def quarter_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of both features into four leaves, on a table of sums."""
    cg, ch = (np.pad(t.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for t in (g, h))
    rows, cols = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]

    def corners(c):
        a, b, d = c[rows, cols], c[rows, -1:].reshape(-1, 1) + 0 * cols, c[-1:, cols].reshape(1, -1) + 0 * rows
        return a, b - a, d - a, c[-1, -1] - b - d + a

    gs, hs = corners(cg), corners(ch)
    gain = sum(x**2 / (y + RIDGE) for x, y in zip(gs, hs, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for k, (r, c) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[r, c] = gs[k][i, j] / (hs[k][i, j] + RIDGE)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Additive:
    """Boost shallow trees on one feature after the other, in cycles, then on the pairs that gain most.

    ``aside`` marks rows that only decide when to stop.
    """
    if not len(y):
        return Additive(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = binned(x, edges)
    learn = ~aside if (~aside).any() else np.ones(len(y), bool)
    rate = (y[learn].sum() + 0.5) / (learn.sum() + 1.0)
    base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), base)
    chance = lambda: 1.0 / (1.0 + np.exp(-total))

    def loss() -> float:
        rows = aside if aside.any() else learn
        p = np.clip(chance()[rows], 1e-9, 1 - 1e-9)
        return float(-(y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p)).mean())

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = chance()
        return np.bincount(at[learn], (y - p)[learn], size), np.bincount(at[learn], (p * (1 - p))[learn], size)

    def boost(tables: list[np.ndarray], step) -> list[np.ndarray]:
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(ROUNDS):
            for k in range(len(tables)):
                step(tables, k)
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif (since := since + 1) >= PATIENCE:
                break
        return kept

    def one(tables: list[np.ndarray], j: int) -> None:
        nonlocal total
        tree, _ = shallow_tree(*sums(bins[j], len(tables[j])), LEAVES)
        tables[j] += RATE * tree
        total = total + RATE * tree[bins[j]]

    tables = boost([np.zeros(len(e) + 1) for e in edges], one)
    total = base + sum(t[b] for t, b in zip(tables, bins, strict=True))

    coarse = [b * PAIR_BINS // (len(e) + 1) for b, e in zip(bins, edges, strict=True)]
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        g, h = sums(coarse[i] * PAIR_BINS + coarse[j], PAIR_BINS**2)
        gains.append((quarter_tree(g.reshape(PAIR_BINS, -1), h.reshape(PAIR_BINS, -1))[1], i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS] if len(edges[i]) and len(edges[j])]

    def two(tables: list[np.ndarray], k: int) -> None:
        nonlocal total
        (i, j), shape = chosen[k], tables[k].shape
        g, h = sums(bins[i] * shape[1] + bins[j], shape[0] * shape[1])
        tree, _ = quarter_tree(g.reshape(shape), h.reshape(shape))
        tables[k] += RATE * tree
        total = total + RATE * tree[bins[i], bins[j]]

    pairs = boost([np.zeros((len(edges[i]) + 1, len(edges[j]) + 1)) for i, j in chosen], two)
    return Additive(base, edges, tables, [(i, j, t) for (i, j), t in zip(chosen, pairs, strict=True)])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Features of whole texts only are inputs. The model learns from at most ``sample`` labelled rows
    (those with the smallest hash of their id) whose ``crc32(id as text)`` modulo ``folds`` is not
    ``held_out_fold``. Its tables, a few thousand numbers, are shipped to the tasks.

    Null or empty text: all features 0, scored like any other. Null id: scored, not held out, not
    learned from. Null labels are not learned from; repeated labels each count. No labels at all:
    score 0.5 and prediction 1 everywhere. Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t) for t in batch.column(2).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], schema=schema)

    held = F.coalesce(fold_of(id_col, folds) == held_out_fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    measured = stored(rows.mapInArrow(features, "doc_id long, held_out boolean, x array<double>"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = measured.where("not held_out").join(marks, "doc_id")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).select("doc_id", "y", "x").toArrow()
    ids, y = known.column("doc_id").to_numpy(), (known.column("y").to_numpy() >= 0.5).astype(float)
    x = known.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    model = Shipped(spark, fit(x, y, ids % 7 == 3))
    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.score(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield record_batch(result, (batch.column(0), batch.column(1), p, (p >= 0.5).astype(np.int32)))

    return measured.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
