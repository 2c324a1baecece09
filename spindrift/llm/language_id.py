"""Language identification as a mixture of languages, fitted to each document by EM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, fresh, record_batch, small_batches

#: Buckets of hashed character trigrams; a model has this many numbers for each language.
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Characters that are worked on at a time.
PIECE = 400_000
SWEEPS = 14
#: Languages with a smaller share after the first sweeps leave the set before it is weighed.
LEAST_SHARE = 0.05
#: Log-likelihood that each further language must gain, in units of the log of the number of trigrams.
PENALTY = 1.5


class Letters:
    """Which code points are letters; made once for each task."""

    def __init__(self):
        self.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """``(document, bucket)`` of every trigram whose middle is a letter; other characters count as space."""
    joined = " ".join(["", *(t.lower() for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters.table[points], points, 32).astype(np.uint64)
    middle = np.flatnonzero(points[1:-1] != 32) + 1
    key = (points[middle - 1] << np.uint64(42)) | (points[middle] << np.uint64(21)) | points[middle + 1]
    bucket = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    ends = np.cumsum([1 + len(t.lower()) for t in texts])
    return np.searchsorted(ends, middle, side="right"), bucket.astype(np.int64)


def pieces_of(texts: list[str], most: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in order as groups of pieces of bounded size; a long text is cut before a character
    that is no letter, where no trigram is lost."""
    index, held, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = min(len(text), start + most)
            while end < len(text) and text[end].isalpha() and end - start < 4 * most:
                end += 1
            index.append(i)
            held.append(text[start:end])
            size += end - start
            start = end
            if size >= most:
                yield index, held
                index, held, size = [], [], 0
    if held:
        yield index, held


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over rows ``(text, lang)``; added up in each task before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not texts:
                continue
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for index, held in pieces_of(texts):
                doc, bucket = trigrams(held, letters)
                table = np.bincount(code[np.array(index)[doc]] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, table, strict=True):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield record_batch(schema, ([name] * len(at), at.astype(np.int32), row[at]))

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def infer(texts: list[str], logs: np.ndarray, letters: Letters, sweeps: int, penalty: float) -> tuple[np.ndarray, ...]:
    """``infer_group`` of a batch, in groups of documents of bounded size."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        out.append(infer_group(texts[start:end], logs, letters, sweeps, penalty))
        start = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else infer_group([], logs, letters, sweeps, penalty)


def infer_group(texts: list[str], logs: np.ndarray, letters: Letters, sweeps: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language (an index, -1 for none), score, proportions, and size of the chosen set.

    ``logs`` holds the log-probabilities, (languages, buckets). Expectation-maximisation over all
    languages finds the proportions; small shares leave, the rest is fitted again, and the set is kept
    if it gains more log-likelihood over the best single language than the penalty asks for.
    """
    n, kinds = len(texts), len(logs)
    best, score, shares, sizes = np.full(n, -1), np.zeros(n), np.zeros((n, kinds)), np.zeros(n, np.int64)
    parts = []
    for index, held in pieces_of(texts):
        doc, bucket = trigrams(held, letters)
        parts.append(np.unique(np.array(index)[doc] * BUCKETS + bucket, return_counts=True))
    if not sum(len(k) for k, _ in parts) or not kinds:
        return best, score, shares, sizes
    key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    count = np.bincount(where, np.concatenate([c for _, c in parts]))
    own, first = np.unique(key // BUCKETS, return_index=True)
    row = np.repeat(np.arange(len(own)), np.diff(np.r_[first, len(key)]))
    log = logs.T[key % BUCKETS]
    total = np.add.reduceat(count, first).astype(float)
    single = np.add.reduceat(log * count[:, None], first, axis=0)
    peak = log.max(axis=1)
    chance = np.exp(log - peak[:, None])

    def sweep(pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = pi[row] * chance
        whole = weight.sum(axis=1)
        likelihood = np.add.reduceat(count * (np.log(np.maximum(whole, 1e-300)) + peak), first)
        return np.add.reduceat(weight * (count / np.maximum(whole, 1e-300))[:, None], first, axis=0) / total[:, None], likelihood

    pi = np.full((len(own), kinds), 1.0 / kinds)
    for _ in range(sweeps):
        pi, _ = sweep(pi)
    chosen = (pi >= LEAST_SHARE) | (pi >= pi.max(axis=1, keepdims=True))
    pi = np.where(chosen, pi, 0.0)
    pi /= pi.sum(axis=1, keepdims=True)
    for _ in range(sweeps // 2):
        pi, _ = sweep(pi)
    _, likelihood = sweep(pi)
    size = chosen.sum(axis=1)
    alone = likelihood - penalty * (size - 1) * np.log(np.maximum(total, 2.0)) <= single.max(axis=1)
    top = np.where(alone, single.argmax(axis=1), pi.argmax(axis=1))
    posterior = np.exp(single - single.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    pi = np.where(alone[:, None], np.eye(kinds)[top], pi)
    at = np.arange(len(own))
    best[own], shares[own], sizes[own] = top, pi, np.where(alone, 1, size)
    score[own] = np.clip(np.where(alone, posterior[at, top], pi[at, top]), 0.0, 1.0)
    return best, score, shares, sizes


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out_fold: int = 2, sweeps: int = SWEEPS, penalty: float = PENALTY, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, n_langs, langs)`` for every row; with ``keep``, those
    columns of the table, then ``lang_pred`` and ``score`` (with underscores before them if such are kept).

    Trigram counts are learned from the text and language of all rows whose ``crc32(id as text)``
    modulo ``folds`` is not ``held_out_fold`` and whose language is not null. ``lang_pred`` is the
    language with the largest share in the chosen set, ``score`` that share (for a set of one: its
    posterior among the single languages), ``langs`` the set with its shares.

    Null text, or a text without a letter: ``und``, score 0, no languages. Null id: predicted, not held
    out, not learned from. Repeated rows: each counts and returns. Nothing to learn from: all ``und``.
    Empty table: empty result. Other columns are ignored. The model is 65,536 numbers a language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(fold_of(id_col, folds) == held_out_fold, F.lit(False))
    rows = docs
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learn = docs.where("doc_id is not null and not held_out and lang is not null and text is not null").select("text", "lang")
    counts = trigram_counts(learn).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(names), BUCKETS))
    place = {name: i for i, name in enumerate(names)}
    if names:
        table[[place[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table += SMOOTHING
    shipped = spark.sparkContext.broadcast((names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_langs", pa.int32()), ("langs", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (langs, logs) = Letters(), shipped.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            best, score, shares, sizes = infer(texts, logs, letters, sweeps, penalty)
            sets = [[(langs[j], float(s[j])) for j in np.flatnonzero(s > 0)] for s in shares]
            yield record_batch(schema, (batch.column(0), batch.column(1), [langs[i] if i >= 0 else "und" for i in best], score, sizes.astype(np.int32), pa.array(sets, schema.field("langs").type)))

    if keep is not None:
        new = fresh(rows.select(*keep), "lang_pred", "score")
        wide = T.StructType([*rows.select(*keep).schema, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            letters, (langs, logs) = Letters(), shipped.value
            for batch in batches:
                best, score, _, _ = infer([t or "" for t in batch.column(text_col).to_pylist()], logs, letters, sweeps, penalty)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([langs[i] if i >= 0 else "und" for i in best], pa.string()), pa.array(score)], names=[*batch.schema.names, *new])

        return rows.select(*keep).mapInArrow(add, wide)
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_langs int, langs map<string,double>")
