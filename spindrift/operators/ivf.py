"""A stored vector index: cells of k-means, a folder for each, with product codes of the residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.dense import cosine_topk
from spindrift.operators.ranking import FOUND, Best, top_k
from spindrift.session import stored

#: Vectors that cells and codes are fitted on at most, whatever the table; and of an audit.
SAMPLE, AUDITED = 20_000, 64

#: Parts of a code, and values of a part.
PARTS, VALUES = 8, 256

#: Candidates by codes for each of the k asked for, whose exact nearness is computed.
RERANKED = 10

#: Questions that meet a block of a cell's codes at once, and vectors of a block.
QUESTIONS, BLOCK = 512, 1024


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its folder, the cells' centres and the values of the codes' parts."""

    path: str
    centres: np.ndarray
    values: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(cell, id, code, vector)``"""
        return spark.read.parquet(f"{self.path}/cells")

    def codes(self, spark: SparkSession) -> DataFrame:
        """``(cell, ids, codes)``: the codes alone, in blocks."""
        return spark.read.parquet(f"{self.path}/codes")


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2.0 * vectors @ centres.T, axis=1)


def k_means(vectors: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of a bounded sample; an empty one starts again at a vector."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.permutation(len(vectors))[:k]]
    for _ in range(rounds):
        own = nearest_centre(vectors, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        spare = vectors[rng.integers(0, len(vectors), len(centres))]
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], spare)
    return centres


def usable(vector: Column) -> Column:
    """Not null, not zero, no component null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def residual_parts(values: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """The code of each residual: for every part the nearest value's number."""
    width = values.shape[2]
    return np.stack([nearest_centre(residuals[:, p * width : (p + 1) * width], values[p]) for p in range(len(values))], axis=1).astype(np.uint8)


def build_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Write an index of all usable vectors to ``path``.

    Cells and codes are fitted on at most ``SAMPLE`` vectors, those with the least hash of their id; every vector is
    indexed. ``cells`` is the square root of the sample's size if it is not given. A cell's rows are in a folder of
    its own, dealt out by a hash too, so that a crowded cell is several files.
    """
    spark = vectors.sparkSession
    held = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    some = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    if not some:
        raise ValueError("there is no vector to index")
    sample = unit(np.array([r[0] for r in some]))
    size = sample.shape[1]
    parts = PARTS if size % PARTS == 0 else 1
    centres = k_means(sample, cells or max(1, round(len(sample) ** 0.5)), seed)
    residuals = sample - centres[nearest_centre(sample, centres)]
    width = size // parts
    values = np.stack([k_means(residuals[:, p * width : (p + 1) * width], min(VALUES, len(sample)), seed + p) for p in range(parts)])
    shared = spark.sparkContext.broadcast((centres, values))
    schema = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("code", pa.binary()), ("vector", pa.list_(pa.float64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, values = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = unit(matrix(batch.column(1)))
            cell = nearest_centre(own, centres)
            codes = residual_parts(values, own - centres[cell])
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], schema=schema)

    placed = held.mapInArrow(place, "cell int, id long, code binary, vector array<double>")
    order = ("cell", "deal", "id")
    dealt = placed.withColumn("deal", F.xxhash64("id")).repartitionByRange(*order).sortWithinPartitions(*order).drop("deal")
    dealt.write.partitionBy("cell").parquet(f"{path}/cells")
    blocks = pa.schema([("cell", pa.int32()), ("ids", pa.list_(pa.int64())), ("codes", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
            cuts = [(a, min(a + BLOCK, z)) for s, z in zip(cuts, cuts[1:], strict=False) for a in range(s, z, BLOCK)]
            ids, codes = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            columns = [[cell[a] for a, _ in cuts], [ids[a:z] for a, z in cuts], [b"".join(codes[a:z]) for a, z in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, blocks, strict=True)], schema=blocks)

    written = spark.read.parquet(f"{path}/cells").select(F.col("cell").cast("int").alias("cell"), "id", "code")
    written.mapInArrow(pack, "cell int, ids array<long>, codes binary").repartition("cell", F.col("ids")[0]).write.partitionBy("cell").parquet(f"{path}/codes")
    fitted = [("centres", centres.shape[0], centres.shape[1], centres.tobytes()), ("values", values.shape[0], values.shape[1], values.tobytes())]
    spark.createDataFrame(fitted, "name string, n int, m int, data binary").coalesce(1).write.parquet(f"{path}/fitted")
    return VectorIndex(path, centres, values)


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    held = {r["name"]: r for r in spark.read.parquet(f"{path}/fitted").collect()}
    c, v = held["centres"], held["values"]
    return VectorIndex(path, np.frombuffer(c["data"]).reshape(c["n"], c["m"]), np.frombuffer(v["data"]).reshape(v["n"], v["m"], -1))


def probed_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """``(qid, cell, vector)``: the cells whose centres are nearest to each question; stored."""
    centres = index.centres
    schema = pa.schema([("qid", pa.int64()), ("cell", pa.int32()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = unit(matrix(batch.column(1)))
            n = min(probes, len(centres))
            near = np.argsort((centres**2).sum(axis=1) - 2.0 * own @ centres.T, axis=1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(own)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(near.ravel(), pa.int32()), pa.array(own[at].tolist(), schema.field(2).type)], schema=schema)

    held = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    return stored(held.mapInArrow(run, "qid long, cell int, vector array<double>"))


def by_codes(index: VectorIndex, codes: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """``(qid, cell, id, score)``: the best of each question by codes alone; vectors are not read.

    The inner product with a coded vector is that with the centre and a table's entry for each part. A
    cell's questions are dealt into groups of about ``QUESTIONS``, and each meets its blocks of codes; a
    block gives the k best of each question.
    """
    centres, values = index.centres, index.values
    deals = -(-probed.select("qid").distinct().count() // QUESTIONS) or 1
    asked = probed.groupBy("cell", F.pmod(F.xxhash64("qid"), F.lit(deals)).alias("deal")).agg(F.collect_list(F.struct("qid", "vector")).alias("qs"))
    schema = pa.schema([*FOUND, ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = values.shape[2]
        for batch in batches:
            for row in batch.to_pylist():
                qids, own, ids = np.array([q["qid"] for q in row["qs"]]), np.array([q["vector"] for q in row["qs"]]), np.array(row["ids"])
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                score = np.repeat((own @ centres[row["cell"]])[:, None], len(ids), axis=1)
                for p in range(len(values)):
                    score += (own[:, p * width : (p + 1) * width] @ values[p].T)[:, codes[:, p]]
                best = Best(len(qids), k)
                best.add(ids, score)
                out = best.rows(qids, FOUND)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, row["cell"]), pa.int32())], schema=schema)

    return codes.join(asked, "cell").select(F.col("cell").cast("int").alias("cell"), "qs", "ids", "codes").mapInArrow(run, "qid long, id long, score double, cell int")


def probe(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``(qid, id, score, rank)`` among the probed cells: codes first, exact cosines for the best of these.

    Only folders of probed cells are read, and their vectors only where codes put them among the
    best ``RERANKED`` k of a question.
    """
    spark = queries.sparkSession
    probed = probed_cells(index, queries, probes)
    cells = [r[0] for r in probed.select("cell").distinct().collect()]  # no more than the index has
    if not cells:
        return spark.createDataFrame([], "qid long, id long, score double, rank long")
    rows, codes = (t.where(F.col("cell").isin(cells)) for t in (index.rows(spark), index.codes(spark)))
    near = stored(top_k(by_codes(index, codes, probed, RERANKED * k), RERANKED * k).select("qid", "cell", "id"))
    vectors = probed.groupBy("qid").agg(F.first("vector").alias("own"))
    pairs = near.join(rows.select("cell", "id", "vector"), ["cell", "id"]).join(vectors, "qid")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("own", "vector", lambda a, x: a * x), F.lit(0.0), lambda a, x: a + x)
    return top_k(pairs.select("qid", "id", F.round(dot / norm, 6).alias("score")).distinct(), k)


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95, probes: int = 4) -> DataFrame:
    """``(qid, id, score, rank)``: the k nearest rows by cosine.

    An audit asks up to ``AUDITED`` of the questions exactly; while the probes find less than ``recall`` of that, the
    number of probes doubles. Where that would read all cells, all rows are compared exactly.
    """
    sample = stored(queries.orderBy(F.xxhash64("qid"), "qid").limit(AUDITED))
    rows = index.rows(queries.sparkSession).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
    want = stored(cosine_topk(rows, sample, k))
    n = want.count()
    while probes < len(index.centres):
        hit = probe(index, sample, k, probes).join(want, ["qid", "id"], "left_semi").count()
        if hit >= recall * n:
            return probe(index, queries, k, probes)
        probes *= 2
    return cosine_topk(rows, queries, k)
