"""Every query runs on the smallest tables and equals its SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as driver
from spindrift.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return x.isoformat() if isinstance(x, datetime.date) else repr(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["qid", "id", "score", "rank"] and df.count() > 0


def test_streams_equal_their_batches(spark):
    streamed = {tuple(r) for r in QUERIES["stream_rate_windows"](spark, SF).collect()}
    batch = {tuple(r) for r in QUERIES["rate_limit_windows"](spark, SF).collect()}
    assert streamed <= batch and len(streamed) > 0.8 * len(batch)


def test_sessions_part_at_half_an_hour(spark, tmp_path):
    at = lambda seconds: None if seconds is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)
    times = {1: [0, 1799], 2: [0, 1800], 3: [0, 1801], 4: [0.9, 1800.1, 3600], 5: [0, 60, 60, 1860], 6: [0, None, None], 7: [None], None: [0, 5, 1805]}
    rows = [(i, at(t), user) for i, (user, t) in enumerate((user, t) for user, own in times.items() for t in own)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["events_sessions"]).fetchall()
    got = [tuple(r) for r in QUERIES["events_sessions"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(n for user, _, n in got if user == 2) == [1, 1]
