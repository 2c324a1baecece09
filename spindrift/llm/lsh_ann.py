"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shipped, batch_rows, record_batch, stored
from .vectors import matrix, usable

log = logging.getLogger(__name__)

#: Hash tables, the width of a cell (vectors are hashed at length 1), and the estimated chances of
#: success at which a query stops to probe a table: the next one where the audit finds the recall low.
TABLES, WIDTH, SUCCESS = 2, 2.4, (0.66, 0.85, 0.97)
#: Queries that are compared with all rows, and the recall of theirs that is enough.
AUDITED, LEAST_RECALL = 64, 0.92
#: Vectors of a block of a bucket, and queries of a chunk that meet a block at a time.
BLOCK, QUERIES = 1024, 512
#: Buckets of each table that a query visits first, to bound what the others need to report.
FIRST = 8
#: The fewest hashes, and the most buckets of a table that a query visits; queries that find too little are searched exactly.
HASHES, PROBES = 6, 3**10
SEED = 11


def hash_count(rows: int) -> int:
    """Hashes that name a bucket: more for larger tables, so that buckets keep their size."""
    return max(HASHES, round(np.log2(max(rows, 1) / 1024)))


class Hashes:
    """Gaussian projections, which are stable for Euclidean distance, cut into cells of equal width.

    The largest inner product is made the smallest distance: vectors are put into bands of length, a
    factor of the square root of two wide, and one more component brings all of a band to the length
    of its longest, which counts as 1. Queries have length 1, and 0 there. So lengths of any kind
    hash alike, and a band is part of a bucket's name.
    """

    def __init__(self, size: int, count: int, tables: int, longest: dict[int, float], width: float, reach: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.normal(size=(tables, count, size + 1))
        self.b = rng.uniform(0, width, (tables, count))
        self.width, self.reach, self.longest = width, reach, longest

    def cells(self, x: np.ndarray, bands: np.ndarray, table: int) -> np.ndarray:
        most = np.array([self.longest[b] for b in bands.tolist()])[:, None]
        unit = x / most
        more = np.sqrt(np.maximum(1.0 - (unit**2).sum(axis=1), 0.0))
        p = np.column_stack([unit, more]) @ self.a[table].T + self.b[table]
        return pack(np.floor(p / self.width).astype(np.int64), bands)

    def probes(self, q: np.ndarray, table: int, success: float) -> list[np.ndarray]:
        """The cells that each query visits: its own and perturbed ones by estimated chance of success.

        The chance that a neighbour at the expected distance falls into a cell is the product over
        the projections of a normal probability (by its logistic approximation). Cells are listed
        hash by hash, the best so far only, and probing stops when they add up to ``success``.
        """
        p = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]) @ self.a[table].T + self.b[table]
        home = np.floor(p / self.width).astype(np.int64)
        low = (home[:, :, None] + np.array([-1, 0, 1])) * self.width - p[:, :, None]
        normal = lambda z: 1.0 / (1.0 + np.exp(-1.702 * z / self.reach))
        log_chance = np.log(np.maximum(normal(low + self.width) - normal(low), 1e-12))
        out = []
        for i in range(len(q)):
            score, steps = np.zeros(1), np.zeros((1, 0), np.int64)
            for own in log_chance[i]:
                score = (score[:, None] + own[None, :]).ravel()
                steps = np.column_stack([np.repeat(steps, 3, axis=0), np.tile([-1, 0, 1], len(steps))])
                if len(score) > PROBES:
                    best = np.argpartition(-score, PROBES - 1)[:PROBES]
                    score, steps = score[best], steps[best]
            order = np.argsort(-score, kind="stable")
            n = int(np.searchsorted(np.exp(score[order]).cumsum(), success)) + 1
            out.append(home[i] + steps[order[:n]])
        return out


def pack(cells: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """A bucket's code: a 64-bit mix of its band and cell numbers."""
    out = bands.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(cells.shape[1]):
        out = (out ^ (cells[:, j].astype(np.uint64) + np.uint64(j * 1_000_003))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each query, ties to the smaller row id; equal pairs count once."""
    order = np.lexsort((row, -score, query))
    q, r = query[order], row[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])] if len(q) else np.zeros(0, bool)
    order, q = order[once], q[once]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    at = np.arange(len(q))
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def score_block(ids: list[np.ndarray], x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact scores of a block of vectors, each with its ids, for some queries: the k best of each, not under its bound."""
    rough = q @ x.T
    names = np.array([i[0] for i in ids])
    order = np.argsort(names, kind="stable")
    first = np.r_[0, np.flatnonzero(np.diff(names[order])) + 1]
    others = np.where(query_ids[:, None] == names[None, :], -np.inf, rough)
    of_id = np.maximum.reduceat(others[:, order], first, axis=1)  # vectors that share an id count once
    least = bound
    if len(first) > k:
        least = np.maximum(least, np.partition(of_id, len(first) - k, axis=1)[:, len(first) - k])
    i, j = np.nonzero(rough >= (least - 1e-9 * np.abs(np.where(least > -np.inf, least, 0)) - 1e-300)[:, None])
    score = np.einsum("ij,ij->i", q[i], x[j])  # one order of summation for every pair, so that copies tie
    sizes = np.array([len(ids[n]) for n in j], np.int64)
    row, i, score = np.concatenate([ids[n] for n in j]) if len(j) else np.zeros(0, np.int64), np.repeat(i, sizes), np.repeat(score, sizes)
    good = (score >= bound[i]) & (row != query_ids[i])
    row, i, score = row[good], i[good], score[good]
    best = best_of(query_ids[i], row, score, k)
    return query_ids[i][best], row[best], score[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, width: float = WIDTH, success: tuple[float, ...] = SUCCESS, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that is a query, the k rows with the largest
    inner product among those in the buckets that it probes, nearest first, ties to the smaller id.

    All vectors are indexed, and every vector in a probed bucket is scored exactly in double precision;
    candidates of the tables are then merged. Equal vectors are indexed once, with their ``k + 1``
    smallest ids: no other can be among the nearest. Buckets are cut into blocks and queries into
    chunks, and a block meets a chunk in a row of its own, so no bucket meets in one task as a whole.
    The expected distance of a neighbour comes from a few queries that are compared with all rows;
    these also audit the recall, and where it is low all queries probe more. Queries that found
    fewer than k rows are then searched exactly, in blocks.

    Vectors that are null, zero, hold null or non-finite components, or have another length than
    most, take no part, nor do rows with a null id. Rows that share an id with the query are its
    own; rows that share an id otherwise give one result with the best score. With fewer than k
    other rows, all are returned. Empty table: empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("v"))
    # Of the sizes there are, the commonest: one row for each size comes to the driver's sort, one to the driver.
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == int(sizes["size"]))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    once = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = once.withColumn("at", smallest).where(F.col("at") <= k + 1)
    nodes = held.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes.select("v", "ids", length.alias("length")).withColumn("band", F.floor(2 * F.log2("length")).cast("int")))
    queries = stored(once.where("asks").select(F.xxhash64("id", "v").alias("q"), "id", F.col("v").cast("array<double>").alias("v")))
    longest = {r["band"]: r["most"] for r in nodes.groupBy("band").agg(F.max("length").alias("most")).collect()}  # some thousands at most
    n_queries, n_ids = queries.count(), once.select("id").distinct().count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chunks = -(-n_queries // QUERIES)
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int"))
    chunked = stored(queries.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("q", "id", "v"))).alias("queries")))
    asked = queries.orderBy(F.xxhash64(F.lit(seed), "q"), "q").limit(AUDITED).select("id", "v").toArrow()
    truth, reach = true_neighbours(nodes, asked.column("id").to_numpy(), matrix(asked.column("v")), k, longest)

    shipped = Shipped(spark, Hashes(int(sizes["size"]), hash_count(nodes.count()), tables, longest, width, reach, seed))
    kind = "array<float>" if rows.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
    where = pa.schema([("tab", pa.int32()), ("bucket", pa.int64()), ("v", pa.list_(pa.float32() if kind == "array<float>" else pa.float64())), ("ids", pa.list_(pa.int64()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, bands = matrix(batch.column(0)), batch.column(2).to_numpy()
                for t in range(tables):
                    yield record_batch(where, (np.full(len(x), t, np.int32), shipped.value.cells(x, bands, t), batch.column(0).cast(where.field("v").type), batch.column(1).cast(where.field("ids").type)))

    with batch_rows(spark, 1000):
        placed = stored(nodes.select("v", "ids", "band").mapInArrow(index, f"tab int, bucket long, v {kind}, ids array<long>"))
    parts = stored(placed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    cut = placed.join(parts, ["tab", "bucket"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    # Dealt out by block: by bucket alone, a hot bucket would be gathered in one task.
    spread = cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tab", "bucket", "part")
    blocks = stored(spread.groupBy("tab", "bucket", "part").agg(F.collect_list(F.struct("ids", "v")).alias("held")))
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def merged() -> tuple:
            q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
            best = best_of(q, r, s, k)
            return q[best], r[best], s[best]

        for batch in batches:
            for i in range(batch.num_rows):
                block, chunk, wanted = (batch.column(c).slice(i, 1).flatten() for c in range(3))
                lists = block.field("ids")
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                ids = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                where_ = np.searchsorted(chunk.field("q").to_numpy(), wanted.field("q").to_numpy())
                q = matrix(chunk.field("v"))[where_]
                found.append(score_block(ids, matrix(block.field("v")), chunk.field("id").to_numpy()[where_], q, wanted.field("bound").to_numpy(zero_copy_only=False), k))
                held += len(found[-1][0])
                if held > 1_000_000:
                    found = [merged()]
                    held = len(found[0][0])
                    if held > 500_000:
                        yield record_batch(found_schema, found[0])
                        found, held = [], 0
        if found:
            yield record_batch(found_schema, merged())

    def visit(pairs: DataFrame) -> DataFrame:
        """``(query_id, vec_id, score)`` of ``(tab, bucket, part, chunk, q, bound)``, some of it twice."""
        met = pairs.groupBy("tab", "bucket", "part", "chunk").agg(F.collect_list(F.struct("q", "bound")).alias("wanted"))
        met = met.join(blocks, ["tab", "bucket", "part"]).join(chunked, "chunk").select("held", "queries", "wanted")
        with batch_rows(spark, 16):  # a row holds a block and a chunk
            return stored(met.mapInArrow(search, "query_id long, vec_id long, score double"))

    def best(met: DataFrame) -> DataFrame:
        each = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    probed = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("chunk", pa.int32()), ("tab", pa.int32()), ("bucket", pa.int64()), ("early", pa.bool_()), ("most", pa.float64())])
    nothing = F.lit(float("-inf"))

    def probe(chance: float) -> DataFrame:
        """Every query's buckets, those that exist, and the most that a vector there can score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine: Hashes = shipped.value
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    q = matrix(part.column(3))
                    norm = np.linalg.norm(q, axis=1)
                    for t in range(tables):
                        cells = mine.probes(q, t, chance)
                        own = np.repeat(np.arange(len(q)), [len(c) for c in cells])
                        early, flat, take = np.concatenate([np.arange(len(c)) < FIRST for c in cells]), np.concatenate(cells), pa.array(own)
                        for band, most in mine.longest.items():
                            yield record_batch(probed, (part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), np.full(len(own), t, np.int32), pack(flat, np.full(len(own), band)), early, norm[own] * most * (1 + 1e-9)))

        with batch_rows(spark, 1000):
            asks = queries.select("q", "id", "chunk", "v").mapInArrow(run, "q long, id long, chunk int, tab int, bucket long, early boolean, most double")
            return stored(asks.join(parts, ["tab", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))

    def hashed(chance: float) -> DataFrame:
        # The likeliest buckets first. Their k-th score bounds what the other buckets have to report.
        probes = probe(chance)
        early = visit(probes.where("early").withColumn("bound", nothing))
        bounds = best(early).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        later = probes.where("not early").join(bounds, "id", "left").withColumn("bound", F.coalesce("least", nothing)).where("most >= bound")
        return stored(best(early.unionByName(visit(later))))

    for chance in success:
        found = hashed(chance)
        recall = recall_of(found, truth)
        log.info("success %.2f: recall %.3f", chance, recall)
        if recall >= LEAST_RECALL:
            break
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n_ids - 1)).select(F.col("query_id").alias("id"))
    poor = queries if recall < LEAST_RECALL else queries.join(enough, "id", "left_anti")
    poor = stored(poor.select("q", "id", "chunk"))
    if poor.isEmpty():
        return found
    names = blocks.where("tab = 0").select("tab", "bucket", "part")
    asking = poor.groupBy("chunk").agg(F.collect_list(F.struct("q", nothing.alias("bound"))).alias("wanted"))
    numbers = names.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = numbers.join(asking, "chunk").join(blocks, ["tab", "bucket", "part"]).join(chunked, "chunk").select("held", "queries", "wanted")
    with batch_rows(spark, 16):
        exact = stored(best(met.mapInArrow(search, "query_id long, vec_id long, score double")))
    kept = found.join(poor.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.unionByName(exact)


def true_neighbours(nodes: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, longest: dict[int, float]) -> tuple[DataFrame, float]:
    """The nearest rows of a few queries among all, and the median distance at which they hash."""
    spark = nodes.sparkSession
    shipped = spark.sparkContext.broadcast((ids, q, longest))  # AUDITED vectors
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("away", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, most = shipped.value
        norm = dict(zip(own.tolist(), np.linalg.norm(asked, axis=1).tolist(), strict=True))
        found: list = []

        def merged() -> list:
            one, two, s, far = (np.concatenate(x) for x in zip(*found, strict=True))
            best = best_of(one, two, s, k)
            return [(one[best], two[best], s[best], far[best])]

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            names = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            one, two, s = score_block(names, matrix(batch.column(0)), own, asked, np.full(len(own), -np.inf), k)
            band = np.empty(0, np.int64)
            owner = {int(i): b for n, b in zip(names, batch.column(2).to_pylist(), strict=True) for i in n}
            band = np.array([owner[int(i)] for i in two])
            scale = np.array([norm[int(i)] for i in one]) * np.array([most[b] for b in band.tolist()])
            found.append((one, two, s, np.sqrt(np.maximum(2 - 2 * s / scale, 0.0))))
            if len(found) > 64:
                found = merged()
        if found:
            yield record_batch(schema, merged()[0])

    with batch_rows(spark, 1000):
        met = nodes.select("v", "ids", "band").mapInArrow(run, "query_id long, vec_id long, score double, away double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        each = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("away").alias("away"))
        truth = stored(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    away = truth.agg(F.median("away")).first()[0]
    return truth, float(max(away, 0.2)) if away is not None else 1.0


def recall_of(found: DataFrame, truth: DataFrame) -> float:
    """Share of the audited queries' true neighbours that were found."""
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    every = truth.count()
    return hit / every if every else 1.0
