"""Exact percentiles, variants' numbers, and keyed state over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators.metrics import floor_percentiles
from spindrift.operators.temporal import admit, cache_hits
from spindrift.streaming import state

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize(("most", "bins"), [(10_000, 1024), (5, 3), (1, 2)])
def test_percentiles(spark, most, bins):
    rng = random.Random(most)
    groups = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [7.0] * 50, "c": [1.0], "d": [rng.choice([1.0, 1.0, 2.0, 1e9]) for _ in range(200)], None: [float(i) for i in range(40)], "e": [10.0 ** rng.randrange(-30, 30) for _ in range(60)]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("f", None)]
    out = floor_percentiles(spark.createDataFrame(rows, "k string, x double").repartition(5), "k", "x", SHARES, most, bins)
    want = {g: tuple(sorted(vs)[min(int(len(vs) * p), len(vs) - 1)] for p in SHARES.values()) for g, vs in groups.items()}
    assert {r["k"]: tuple(r)[1:] for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().toString()


def test_variants_have_numbers(spark):
    from spindrift.plans.hybrid import VARIANTS, retrieve_plans

    docs = spark.createDataFrame([(0, "apple pear"), (1, "plum"), (2, "grape")], "doc_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    plans = lambda rows: spark.createDataFrame(rows, "qid long, variant_no int, query string")
    none = spark.createDataFrame([], "qid long, variant_no int, vector array<double>")
    found = retrieve_plans(docs, vectors, plans([(-1, VARIANTS - 1, "apple"), (0, 0, "plum"), (1 << 54, 1, "grape")]), none).collect()
    assert {(r["qid"], r["id"]) for r in found} == {(-1, 0), (0, 1), (1 << 54, 2)}
    with pytest.raises(Exception, match="no such variant: 64"):
        retrieve_plans(docs, vectors, plans([(0, VARIANTS, "apple"), (1, 0, "plum")]), none).collect()


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a processor over batches of events, one file each, in order of time."""

    def run(rows, columns, processor, batches=4):
        rows = sorted(rows)
        for i in range(batches):
            part = rows[len(rows) * i // batches : len(rows) * (i + 1) // batches]
            spark.createDataFrame(part, columns).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        out = str(tmp_path / "out")
        with state.state_on_disk(spark):
            source = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            query = state.keyed(source, processor, "1 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
            query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    return run


def calls(seed):
    rng = random.Random(seed)
    return [(rng.randrange(0, 2000), i, rng.choice("abc"), rng.random() < 0.8) for i in range(300)]


COLUMNS = "seconds long, event_id long, key string, cacheable boolean"


def test_limiter_goes_on_over_batches(spark, stream):
    rows = calls(1)
    got = {tuple(r) for r in stream(rows, COLUMNS, state.Limiter(3, 60)).select("event_id", "bucket", "admitted").collect()}
    batch = admit(spark.createDataFrame(rows, COLUMNS), "key", F.col("seconds"), ["seconds", "event_id"], 3, 60)
    assert got == {tuple(r) for r in batch.select("event_id", "bucket", "admitted").collect()}


def test_cache_goes_on_over_batches(spark, stream):
    rows = calls(2)
    got = {tuple(r) for r in stream(rows, COLUMNS, state.Cache(90)).select("event_id", "hit").collect()}
    assert got == {tuple(r) for r in cache_hits(spark.createDataFrame(rows, COLUMNS), 90).select("event_id", "hit").collect()}


def test_job_states(spark, stream):
    columns = "seconds long, event_id long, key string, kind string"
    rows = [(1, 1, "a", "started"), (2, 2, "b", "started"), (3, 3, "a", "finished"), (4, 4, "c", "noise"), (5, 5, "b", "failed"), (6, 6, "b", "started"), (7, 7, "d", "started")]
    out = stream(rows, columns, state.Jobs(10_000), 3)
    last = out.groupBy("key").agg(F.max_by("status", F.struct("seconds", "event_id")).alias("status"))
    assert {tuple(r) for r in last.collect()} == {("a", "done"), ("b", "processing"), ("d", "processing")}
    assert {tuple(r) for r in state.latest_status(spark.createDataFrame(rows, columns)).collect()} == {("a", "done"), ("b", "processing"), ("d", "processing")}
