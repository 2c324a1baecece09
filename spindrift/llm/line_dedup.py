"""Line deduplication: lines that many documents share stay in one document only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, as_bytes, fresh, record_batch, small_batches, stored


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line without outer white space and with A-Z lowered; None if it is short."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs, drops)``: the distinct line keys of each document, and those to drop with the keeper.

    The keys are counted with map-side aggregation, so a line found in a third of all documents is
    a few rows by the time it is shuffled.
    """
    schema = pa.schema([("doc", pa.int64()), ("key", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for line in as_bytes(text).split(b"\n") if (k := line_key(line, min_chars))}
                ids += [doc] * len(own)
                out += own
            yield record_batch(schema, (ids, out))

    pairs = stored(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null").mapInArrow(keys, "doc long, key binary"))
    drops = pairs.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper")
    # Written, so that a later join deals out both sides itself: only then can Spark split a hot key.
    return pairs, stored(drops)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """All columns of ``docs`` with the text rebuilt from the lines that stay, plus
    ``n_lines`` and ``n_dropped`` (renamed with leading underscores if the table has such columns).

    A text is split at newlines. A line's key is the line without outer ASCII white space, A-Z
    lowered; keys of at least ``min_chars`` code points found in at least ``min_docs`` documents
    lose all their lines except in the largest id that holds them. Other lines stay in place and
    are joined by newlines.

    Null or empty text: one empty line, an empty text. Null id: the row keeps all its lines and
    counts as no document. Repeated ids: they count as one document, and each row is cut alike.
    Empty table: empty result. Extra columns pass through.
    """
    small_batches(docs.sparkSession)
    pairs, drops = shared_lines(docs, id_col, text_col, min_docs, min_chars)
    doc, gone, n_lines, n_dropped = fresh(docs, "doc_key", "dropped_keys", "n_lines", "n_dropped")
    hit = pairs.join(drops, "key").where("doc <> keeper").groupBy("doc").agg(F.collect_set("key").alias(gone)).withColumnRenamed("doc", doc)
    joined = docs.withColumn(doc, F.col(id_col).cast("long")).join(hit, doc, "left").drop(doc)
    target = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long")}).schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, lost = [], [], []
            for text, keys in zip(batch.column(text_col).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                lines = as_bytes(text).split(b"\n")
                if keys:
                    keys = set(keys)
                    stay = [x for x in lines if line_key(x, min_chars) not in keys]
                else:
                    stay = lines
                total.append(len(lines))
                lost.append(len(lines) - len(stay))
                texts.append(b"\n".join(stay).decode())
            columns = [pa.array(texts, pa.string()) if name == text_col else batch.column(name) for name in batch.schema.names if name != gone]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*(n for n in batch.schema.names if n != gone), n_lines, n_dropped])

    return joined.mapInArrow(rebuild, target)
