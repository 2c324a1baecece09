"""Stores: what a mutation leaves, what it rewrites, and what two writers do to one another."""

import os

import pytest
from pyspark.sql import functions as F

from spindrift.operators import store
from spindrift.operators.store import Conflict, Store


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "k int, v string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_of_a_row_rewrites_its_bucket(spark, make, tmp_path):
    held = Store(spark, str(tmp_path), ["k"], 16).create(make([(i, "old") for i in range(200)]))
    before = files(tmp_path / "data")
    held.upsert(make([(7, "new")]), ["k"])
    after = files(tmp_path / "data")
    changed = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert len(changed) == 1 and held.version == 2
    assert rows(held.read()) == [(i, "new" if i == 7 else "old") for i in range(200)]


def test_mutations_run_again_without_effect(spark, make, tmp_path):
    held = Store(spark, str(tmp_path), ["k"], 4).create(make([(1, "a"), (2, None), (None, "n")]))
    for _ in range(2):
        held.insert_if_absent(make([(1, "x"), (3, "c"), (3, "b"), (None, "m")]), ["k"])
        assert rows(held.read()) == [(None, "n"), (1, "a"), (2, None), (3, "b")]
    for _ in range(2):
        held.upsert(make([(1, "new"), (9, "z"), (None, "null")]), ["k"])
        assert rows(held.read()) == [(None, "null"), (1, "new"), (2, None), (3, "b"), (9, "z")]
    for _ in range(2):
        held.replace_groups(make([(None, "x"), (None, "y"), (1, "z")]), ["k"])
        assert rows(held.read()) == [(None, "x"), (None, "y"), (1, "z"), (2, None), (3, "b"), (9, "z")]
    for _ in range(2):
        held.backfill(make([(1, "no"), (2, "late"), (2, "b"), (9, None)]), ["k"], "v", batch=1)
        assert rows(held.read())[3] == (2, "b")
    for _ in range(2):
        held.delete(make([(k, "") for k in (1, 2, 3, 9, None)]), ["k"])
        assert rows(held.read()) == []
    held.insert_if_absent(make([]), ["k"])
    assert rows(held.read()) == []


def test_the_last_of_new_rows(make):
    new = make([(1, "b"), (1, "c"), (1, "a")]).withColumn("at", F.when(F.col("v") == "b", 9).otherwise(1))
    assert rows(store.upsert(make([(1, "old")]), new, ["k"], F.col("at"))) == [(1, "b")]
    assert rows(store.upsert(make([(1, "old")]), new, ["k"])) == [(1, "a")]


def test_a_second_writer_fails(spark, make, tmp_path):
    one, two = (Store(spark, str(tmp_path), ["k"], 4) for _ in range(2))
    one.create(make([(1, "a")]))

    def slow(held):
        two.upsert(make([(1, "two"), (2, "two")]), ["k"])  # another writer is faster
        return store.upsert(held, make([(1, "one")]), ["k"])

    with pytest.raises(Conflict):
        one.change(make([(1, "one")]), ["k"], slow)
    assert rows(one.read()) == [(1, "two"), (2, "two")]
    one.upsert(make([(1, "one")]), ["k"])
    assert rows(two.read()) == [(1, "one"), (2, "two")] and two.version == 3


def test_an_unfinished_writer_is_seen(spark, make, tmp_path):
    held = Store(spark, str(tmp_path), ["k"], 4).create(make([(1, "a")]))
    (tmp_path / "versions" / "2.begun").touch()
    with pytest.raises(Conflict):
        held.upsert(make([(1, "b")]), ["k"])
    held.recover()
    held.upsert(make([(1, "b")]), ["k"])
    assert rows(held.read()) == [(1, "b")]

    def fails(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        held.change(make([(1, "c")]), ["k"], fails)
    assert held.version == 2 and rows(held.read()) == [(1, "b")]


def test_parents_go_after_their_children(spark, make, tmp_path):
    parents = Store(spark, str(tmp_path / "p"), ["k"], 4).create(make([(1, "a"), (2, None), (3, "c")]))
    children = Store(spark, str(tmp_path / "c"), ["k"], 4).create(make([(1, "x"), (1, "y"), (2, "x")]))
    for _ in range(2):
        parents.purge(F.col("v") == "a", children, ["k"])
        assert rows(parents.read()) == [(2, None), (3, "c")] and rows(children.read()) == [(2, "x")]


def test_keys_hold_the_buckets(spark, make, tmp_path):
    held = Store(spark, str(tmp_path), ["k"], 4)
    with pytest.raises(FileNotFoundError):
        held.read()
    held.create(make([(1, "a")]))
    with pytest.raises(ValueError, match="lacks"):
        held.upsert(make([(1, "b")]), ["v"])
    with pytest.raises(ValueError, match="cannot have"):
        Store(spark, str(tmp_path / "x"), ["k"]).create(make([]).withColumn(store.BUCKET, F.lit(1)))


def test_counters(spark, make):
    assert tuple(store.counters(make([(1, "a"), (2, "b"), (3, "c")]), make([(1, "a"), (8, "b"), (8, "c")]), ["k"]).first()) == (3, 1)
    with pytest.raises(RuntimeError):
        store.raise_on_errors(spark.createDataFrame([(200,), (None,)], "status int"))


def test_clean_up(spark):
    from spindrift import session

    before = list(session.WRITTEN)
    session.WRITTEN.clear()  # other tests' tables stay
    held = session.stored(spark.range(3))
    (path,) = session.WRITTEN
    assert held.count() == 3 and os.path.exists(path.removeprefix("file:"))
    assert session.clean_up(spark) == 1 and not os.path.exists(path.removeprefix("file:")) and session.WRITTEN == []
    session.WRITTEN += before


def test_dump_and_restore(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, "x", [1.5], None), (1, "x", [1.5], None), (None, "é\n\"", None, None)], "k int, v string, l array<double>, d date"), "b": spark.createDataFrame([], "k long")}
    store.dump(tables, str(tmp_path / "d"))
    held = store.restore(spark, str(tmp_path / "d"))
    assert {n: sorted(map(str, t.collect())) for n, t in held.items()} == {n: sorted(map(str, t.collect())) for n, t in tables.items()}
    assert held["a"].schema == tables["a"].schema
    tables["a"].limit(1).write.mode("append").option("ignoreNullFields", False).json(str(tmp_path / "d" / "a"))
    with pytest.raises(ValueError, match="a has 4 rows of 3"):
        store.restore(spark, str(tmp_path / "d"))


def test_cached_tables_grow_old(spark, make, tmp_path):
    made = []

    def now(value):
        return lambda: made.append(value) or make([(1, value)])

    ask = lambda at, value: rows(store.cached_table(spark, str(tmp_path / "c"), 60, at, now(value)))
    assert [ask(1000, "a"), ask(1059, "b"), ask(1060, "c"), ask(1061, "d")] == [[(1, "a")], [(1, "a")], [(1, "c")], [(1, "c")]]
    assert made == ["a", "c"]
    (tmp_path / "c" / "2000000").mkdir()  # an unfinished entry
    assert ask(2000, "e") == [(1, "e")]
