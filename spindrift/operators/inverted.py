"""A stored inverted index, partitioned by term, and searches that skip what cannot be among the best.

Documents are cut into ranges. Postings are rows of a term and a range: ids, frequencies, lengths, positions,
and the highest impact that the term has in the range. Rows lie in folders by a bucket of the term,
sorted by term, so a batch of questions opens its own terms' files only. A range whose highest impacts do
not add up to what is among the k best already is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.analysis import PLAIN, Analyser
from spindrift.operators.ranking import top_k
from spindrift.session import small_side, stored

#: Documents of a range, and words after which it ends early.
RANGE_DOCS, RANGE_WORDS = 256, 1_000_000

#: Files of a bucket, at most; more for larger tables.
BUCKET_FILES = 4

#: Ranges of a question that are read first, to know what the others have to reach.
FIRST_RANGES = 4

#: Terms up to which a search also filters by the terms themselves.
NAMED_TERMS = 20_000


@dataclass(frozen=True)
class Inverted:
    """A written index: its folder, its analyser and the constants that its impacts were made with."""

    path: str
    analyser: Analyser
    buckets: int
    n: int
    average: float
    k1: float
    b: float

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/terms")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Range:
    """Documents of a range while they are read: a number for every word, inverted at once at the end."""

    def __init__(self):
        self.ids, self.dls, self.place, self.terms, self.docs, self.spots = [], [], {}, [], [], []
        self.words = 0

    def add(self, doc: int, terms: list[str | None]) -> None:
        place = self.place
        own = np.fromiter((-1 if t is None else place.setdefault(t, len(place)) for t in terms), np.int64, len(terms))
        kept = np.flatnonzero(own >= 0)
        self.terms.append(own[kept])
        self.spots.append((kept + 1).astype(np.int32))
        self.docs.append(np.full(len(kept), len(self.ids)))
        self.ids.append(doc)
        self.dls.append(len(kept))
        self.words += len(kept)

    def rows(self, name: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row without a term for the documents, and one for each term."""
        terms, docs, spots = np.concatenate(self.terms), np.concatenate(self.docs), np.concatenate(self.spots)
        order = np.argsort(terms, kind="stable")  # documents and places are in order already
        terms, docs, spots = terms[order], docs[order], spots[order]
        ends = lambda *keys: np.r_[np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, len(terms)] if len(terms) else np.zeros(0, np.int64)
        pair, term = ends(terms, docs), ends(terms)
        tfs = np.diff(np.r_[0, pair])
        doc = docs[pair - 1]
        ids, dls = np.array(self.ids), np.array(self.dls)
        per_term = np.searchsorted(pair, term, "right")  # pairs up to the end of each term
        first = np.r_[0, len(ids), len(ids) + per_term].astype(np.int32)
        none = np.r_[0, 0, per_term].astype(np.int32)
        listed = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
        places = listed(np.r_[0, pair], spots, pa.int32())
        columns = [
            pa.array([None, *self.place], pa.string()), pa.array(np.full(len(term) + 1, name)), listed(first, np.r_[ids, ids[doc]], pa.int64()),
            listed(none, tfs, pa.int32()), listed(first, np.r_[dls, dls[doc]], pa.int32()), pa.ListArray.from_arrays(pa.array(none), places),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def inverted_ranges(docs: DataFrame, analyser: Analyser, id_col: str, text: Column, range_docs: int) -> DataFrame:
    """``(term, range, ids, tfs, dls, positions)``, and a row without a term for each range's documents."""
    kinds = [("term", pa.string()), ("range", pa.int64()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32())))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = TaskContext.get().partitionId() << 32, Range()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(doc, analyser.terms(body))
                if len(held.ids) == range_docs or held.words >= RANGE_WORDS:
                    yield held.rows(name, schema)
                    name, held = name + 1, Range()
        if held.ids:
            yield held.rows(name, schema)

    held = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("string").alias("t")).where("id is not null")
    return held.mapInArrow(run, "term string, range long, ids array<long>, tfs array<int>, dls array<int>, positions array<array<int>>")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: Column | str = "text", analyser: Analyser = PLAIN, k1: float = 1.2, b: float = 0.75, buckets: int = 64, range_docs: int = RANGE_DOCS) -> Inverted:
    """Write an index of ``docs`` to ``path``.

    Texts are read once. A task inverts its own ranges, so a term that is everywhere never meets in one
    task: its rows are dealt by bucket and range, and sorted by term. Null ids are left out; a null text is empty.
    """
    ranges = stored(inverted_ranges(docs, analyser, id_col, F.col(text) if isinstance(text, str) else text, range_docs))
    sums = ranges.where("term is null").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    n, average = sums["n"] or 0, (sums["words"] or 0) / (sums["n"] or 1) or 1.0
    part = F.zip_with("tfs", "dls", lambda tf, dl: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / average)))
    rows = ranges.where("term is not null").withColumns({"bucket": bucket_of(F.col("term"), buckets), "impact": F.array_max(part)})
    # A bucket is dealt into parts by range as well, so that one with a term of all documents is several files.
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("range"), F.lit(BUCKET_FILES)))
    dealt.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = docs.sparkSession
    terms = rows.groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    index = Inverted(path, analyser, buckets, int(n), float(average), k1, b)
    spark.createDataFrame([(index.n, index.average, k1, b, buckets, analyser.english)], "n long, average double, k1 double, b double, buckets int, english boolean").coalesce(1).write.parquet(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str) -> Inverted:
    m = spark.read.parquet(f"{path}/meta").first()
    return Inverted(path, replace(PLAIN, english=m["english"]), m["buckets"], m["n"], m["average"], m["k1"], m["b"])


def question_terms(queries: DataFrame, analyser: Analyser) -> DataFrame:
    """``(qid, term)``: the different terms of each question, by the index's analyser."""
    schema = pa.schema([("qid", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, t) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in dict.fromkeys(analyser.terms(text)) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=schema.field(i).type) for i in (0, 1)], schema=schema)

    return queries.select(F.col("qid").cast("long").alias("qid"), "query").mapInArrow(run, "qid long, term string").distinct()


def only_asked(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked buckets, and of asked terms if these are few: both filters reach the scan."""
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # no more than the index has
    table = table.where(F.col("bucket").isin(buckets)) if buckets else table.where("false")
    names = [r[0] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    return table.where(F.col("term").isin(names)) if len(names) <= NAMED_TERMS else table


def weighted_terms(index: Inverted, queries: DataFrame) -> DataFrame:
    """``(qid, bucket, term, idf, df)`` of the questions' terms that the index has; stored."""
    spark = queries.sparkSession
    asked = stored(question_terms(queries, index.analyser).withColumn("bucket", bucket_of(F.col("term"), index.buckets)))
    idf = F.log((F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    terms = only_asked(index.terms(spark), asked)
    return stored(asked.join(terms, ["bucket", "term"]).select("qid", "bucket", "term", idf.alias("idf"), "df"))


def range_bounds(index: Inverted, weights: DataFrame) -> DataFrame:
    """``(qid, range, bound)``: no document of the range scores more. Reads terms, ranges and impacts only."""
    heads = only_asked(index.postings(weights.sparkSession), weights).select("bucket", "term", "range", "impact")
    return heads.join(small_side(weights, weights.count()), ["bucket", "term"]).groupBy("qid", "range").agg(F.sum(F.col("idf") * F.col("impact")).alias("bound"))


def scores_in(index: Inverted, weights: DataFrame, ranges: DataFrame, eligible: DataFrame | None) -> DataFrame:
    """``(qid, id, score)`` of all documents of these ranges that share a term with the question."""
    own = only_asked(index.postings(weights.sparkSession), weights).select("bucket", "term", "range", "ids", "tfs", "dls")
    hit = own.join(small_side(weights, weights.count()), ["bucket", "term"]).join(small_side(ranges, ranges.count()), ["qid", "range"])
    each = hit.select("qid", "idf", F.inline(F.arrays_zip("ids", "tfs", "dls")).alias("id", "tf", "dl"))
    part = F.col("idf") * F.col("tf") * (index.k1 + 1.0) / (F.col("tf") + index.k1 * (1.0 - index.b + index.b * F.col("dl") / index.average))
    if eligible is not None:
        each = each.join(eligible.select(F.col(eligible.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    return each.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


def search(index: Inverted, queries: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score, rank)``: the k best documents of each question, as if all were scored.

    The ranges with the highest bounds are scored first. The k-th score found there is what a range's
    bound has to reach; only such ranges are read then. Ties to the smaller id, which is why a bound that
    just reaches it counts. ``eligible`` ids restrict what may be found, not the statistics.
    """
    weights = weighted_terms(index, queries)
    bounds = stored(range_bounds(index, weights))
    first = bounds.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("bound").desc(), "range"))).where(F.col("n") <= FIRST_RANGES).select("qid", "range")
    first = stored(first)
    found = stored(scores_in(index, weights, first, eligible))
    reach = top_k(found, k).groupBy("qid").agg(F.min("score").alias("reach"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "reach")
    more = bounds.join(first, ["qid", "range"], "left_anti").join(small_side(reach, reach.count()), "qid", "left")
    more = stored(more.where("reach is null or bound + 1e-6 >= reach").select("qid", "range"))
    # A document lies in one range, so the two parts share none.
    return top_k(found.unionByName(scores_in(index, weights, more, eligible)), k)


def search_fields(fields: list[tuple[Inverted, float]], queries: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
    """The best field of each document counts, each field with its weight.

    A document among the k best is among the k best of the field that counts for it, so each field is
    searched for k.
    """
    parts = [search(index, queries, k, eligible).select("qid", "id", F.round(F.col("score") * weight, 6).alias("score")) for index, weight in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.repartition("qid", "id").groupBy("qid", "id").agg(F.max("score").alias("score")), k)  # see fuse
