"""Mixing sources to target weights: blocks of words, drawn source by source for each output shard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, as_bytes, fresh, small_batches, stored, words_of

#: Words of a block; sources are cut into blocks of this length (the last of a source may be shorter).
BLOCK = 128
#: Output shards, each with its own multinomial draw.
SHARDS = 64
#: Pieces of a source whose offsets are summed apart, so that no source meets in one task.
PIECES = 1024
SEED = 20_240_607


def fill_to_caps(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split ``share`` times all sizes by weight; what is above ``cap`` times a size is reshared."""
    limits, left = [cap * s for s in sizes], share * sum(sizes)
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > limits[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = limits[i]
        left -= sum(limits[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def draw_shards(slots: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks that each shard takes of each source: multinomial draws by what each source still owes.

    Every shard but the last draws its share of what is left, with chances in proportion to it, so
    the totals come out as planned. Returns an array of shape (shards, sources).
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    for k in range(shards - 1):
        size = int(left.sum()) // (shards - k)
        if size:
            take = np.minimum(rng.multinomial(size, left / left.sum()), left)
            out[k], left = take, left - take
    out[-1] = left
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. n - 1`` for each key: a Feistel network of four rounds,
    walked on while the value is outside the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.int64) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    limit, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the number of words and a hash of the row's source and text; and those names."""
    size, mark = fresh(docs, "mix_size", "mix_mark")
    schema = docs.withColumns({size: F.lit(0).cast("long"), mark: F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = [], []
            for text, source in zip(batch.column(text_col).to_pylist(), batch.column(source_col).to_pylist(), strict=True):
                data = as_bytes(text)
                sizes.append(sum(map(len, words_of(data))))
                marks.append(xxhash.xxh64_intdigest(repr(source).encode() + data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64))], names=[*batch.schema.names, size, mark])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema), [size, mark]


def plan_mix(rows: DataFrame, weights: Sequence[float], share: float, cap: float, block: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(spans, sources)`` for rows ``(doc, source, size, mark)``.

    ``spans`` has a row for each document row and block that overlaps it: ``doc, mark, copy`` name the
    row, ``size`` and ``rank`` its words and source, ``first`` and ``last`` the words of the row in that
    block, and ``times`` how often the mix takes the block. ``sources``: ``rank, source, source_size,
    target``. Only the totals by source pass through the driver.
    """
    spark = rows.sparkSession
    copy = Window.partitionBy("doc", "mark").orderBy("size")
    rows = stored(rows.withColumn("copy", F.row_number().over(copy)).withColumn("piece", F.pmod(F.xxhash64("doc", "mark"), F.lit(PIECES)).cast("int")))
    pieces = stored(rows.groupBy("source", "piece").agg(F.sum("size").alias("words")))
    totals = sorted(((r[0], int(r[1])) for r in pieces.groupBy("source").agg(F.sum("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    targets = fill_to_caps(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(int(cap * b), round(t * b / n)) if n else 0 for n, b, t in zip(sizes, blocks, targets, strict=True)]
    drawn = draw_shards(slots, shards, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    sources = spark.createDataFrame([(i, s, n, float(t)) for i, ((s, n), t) in enumerate(zip(totals, targets, strict=True))], "rank int, source string, source_size long, target double")
    draws = spark.createDataFrame([(k, i, int(first[k, i]), int(drawn[k, i]), blocks[i]) for k in range(shards) for i in range(len(sizes)) if drawn[k, i]], "shard int, rank int, first long, n long, blocks long")

    @F.pandas_udf("long")
    def place(slot: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted((slot % n).to_numpy(), n.to_numpy(), key.to_numpy()))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slot = draws.repartition(parts, "shard", "rank").select("rank", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    key = F.xxhash64(F.lit(seed), "rank", F.floor(F.col("slot") / F.col("blocks")))
    taken = slot.select("rank", place("slot", "blocks", key).alias("block")).groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")  # its size estimate misses the slots

    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("source", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    ranked = sources.select("rank", F.col("source").alias("name"))
    offsets = offsets.join(ranked, F.col("source").eqNullSafe(F.col("name"))).select(F.col("source").alias("own"), F.col("piece").alias("at"), "offset", "rank")
    inside = Window.partitionBy("source", "piece").orderBy("doc", "mark", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("own")) & (F.col("piece") == F.col("at"))).withColumn("start", F.col("offset") + F.col("inside"))
    idx = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    spans = placed.select("doc", "mark", "copy", "size", "rank", "start", F.explode_outer(idx).alias("block")).join(taken, ["rank", "block"], "left")
    low = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    return spans.select("doc", "mark", "copy", "size", "rank", low.alias("first"), high.alias("last"), F.coalesce("times", F.lit(0)).alias("times")), sources


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row.

    A source's documents form one stream of words in a fixed pseudorandom order, cut into blocks of
    ``block`` words. Sources, by code point with null last, take the weights in turn and share
    ``share`` times all words, none above ``cap`` times its own. Each output shard draws multinomial
    counts of blocks; a source's slots map to its blocks through a pseudorandom permutation for each
    pass over them, and slots and blocks join by that index. ``taken`` counts repeats. A source's
    taken words differ from its target by less than three blocks: one by rounding, and as much for each
    pass over its last block, which is shorter than the others; no block is taken more than ``cap``
    times; the same table gives the same result on any cluster.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, the last. Null id
    and repeated ids or rows: each row is a document. Empty table: empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    sized, (size, mark) = measured(docs, "doc", "text", "source")
    spans, sources = plan_mix(sized.select("doc", "source", F.col(size).alias("size"), F.col(mark).alias("mark")), weights, share, cap, block, shards, seed)
    sums = spans.groupBy("doc", "mark", "copy", "size", "rank").agg(F.sum(F.coalesce((F.col("last") - F.col("first")) * F.col("times"), F.lit(0))).alias("taken"))
    return sums.join(sources, "rank").select(F.col("doc").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mix_texts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass in which a document is taken.

    The text is what that pass takes of the document: all of it unchanged if every block is taken,
    else the runs of taken words as they stand, joined by newlines. Documents not taken go.
    Nulls, empty texts and repeats as in ``mix_sizes``.
    """
    sized, (size, mark) = measured(docs, id_col, text_col, source_col)
    rows = sized.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), F.col(size).alias("size"), F.col(mark).alias("mark"))
    spans, _ = plan_mix(rows, weights, share, cap, block, shards, seed)
    runs = spans.where("times > 0").groupBy("doc", "mark", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "last", "times"))).alias("runs"))
    doc, copy, own, other, taken = fresh(sized, "mix_doc", "mix_copy", "own_mark", "own_copy", "mix_runs")
    runs = runs.select(F.col("doc").alias(doc), F.col("mark").alias(own), F.col("copy").alias(other), F.col("runs").alias(taken))
    held = sized.withColumn(copy, F.row_number().over(Window.partitionBy(F.col(id_col).cast("long"), mark).orderBy(size)))
    joined = held.join(runs, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(own)) & (F.col(copy) == F.col(other)))
    keep = docs.columns
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).schema

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, texts = [], []
            for i, (text, spans) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column(taken).to_pylist(), strict=True)):
                for passed in range(max(s["times"] for s in spans)):
                    index.append(i)
                    texts.append(word_runs(text, [(s["first"], s["last"]) for s in spans if s["times"] > passed]))
            rows = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else batch.column(n).take(rows) for n in keep], names=keep)

    return joined.select(*keep, taken).mapInArrow(cut_out, schema)


def word_runs(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans as they stand in the text; adjacent spans stay together."""
    joined: list[list[int]] = []
    for first, last in sorted(spans):
        if joined and joined[-1][1] == first:
            joined[-1][1] = last
        else:
            joined.append([first, last])
    data = text.encode()
    space = np.isin(np.frombuffer(data, np.uint8), np.frombuffer(ASCII_SPACE, np.uint8))
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if joined == [[0, len(starts)]]:
        return text
    return b"\n".join(data[starts[a] : ends[b - 1]] for a, b in joined).decode()
