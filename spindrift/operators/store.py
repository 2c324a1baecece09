"""Stored tables: mutations as set operations on keys, which rewrite the buckets they touch only.

A store is a Parquet table partitioned by a bucket of its key. A mutation reads the buckets that its
change names, and Spark's dynamic partition overwrite puts the new ones in their place. A version is a
marker that is created only if it is absent, so of two writers that started from one version the second
one fails, and its caller starts again from what the first one left. Every mutation may be run again
without a further effect, nulls in keys included, which is how an unfinished run is made good.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "store_bucket"


class Conflict(RuntimeError):
    """Another writer has committed, or is committing, the version that this one was about to make."""


class Store:
    """A table in ``root``, bucketed by the columns ``by``; every mutation's key has to hold these."""

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.by, self.buckets = spark, root.rstrip("/"), list(by), buckets

    # Markers.

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _markers(self) -> list[str]:
        path, fs = self._path("versions")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    @property
    def version(self) -> int:
        """The newest version that was written whole; 0 if there is none."""
        return max((int(n) for n in self._markers() if n.isdigit()), default=0)

    def _mark(self, name: str) -> bool:
        path, fs = self._path(f"versions/{name}")
        fs.mkdirs(path.getParent())
        return fs.createNewFile(path)

    def recover(self) -> None:
        """Let go of a version that a writer began and will not finish; its mutation can then run again."""
        for name in self._markers():
            if name.endswith(".begun"):
                path, fs = self._path(f"versions/{name}")
                fs.delete(path, False)

    # Reading and writing.

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The whole table."""
        return self._rows().drop(BUCKET)

    def _rows(self) -> DataFrame:
        if not self.version:
            raise FileNotFoundError(f"no version in {self.root}")
        return self.spark.read.option("basePath", f"{self.root}/data").schema(self._schema()).parquet(f"{self.root}/data")

    def _schema(self):
        held = self.spark.read.json(f"{self.root}/schema", schema="ddl string").first()["ddl"]
        return self.spark.createDataFrame([], held).schema

    def create(self, df: DataFrame) -> Store:
        """The first version."""
        if BUCKET in df.columns:
            raise ValueError(f"a table cannot have a column {BUCKET}")
        ddl = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(df.schema.json()).toDDL()
        self.spark.createDataFrame([(f"{ddl}, {BUCKET} INT" if ddl else f"{BUCKET} INT",)], "ddl string").coalesce(1).write.mode("overwrite").json(f"{self.root}/schema")
        return self.commit(df, 0)

    def commit(self, rows: DataFrame, after: int, touched: Sequence[int] | None = None) -> Store:
        """Make the version after ``after``: ``rows`` are all that is left in the ``touched`` buckets (None: in all)."""
        mine = f"{after + 1}.begun"
        if self.version != after or not self._mark(mine):
            raise Conflict(f"version {after + 1} of {self.root} is being made, or was made, by another writer")
        try:
            if self.version != after:  # made between both looks
                raise Conflict(f"version {after + 1} of {self.root} was made by another writer")
            made = rows.withColumn(BUCKET, self.bucket())
            made.repartition(BUCKET, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/data")
            self._drop_empty(made, touched)
            self._mark(str(after + 1))
        finally:
            path, fs = self._path(f"versions/{mine}")
            fs.delete(path, False)
        return self

    def _drop_empty(self, made: DataFrame, touched: Sequence[int] | None) -> None:
        """Buckets of which nothing is left; the overwrite leaves them alone."""
        full = {r[0] for r in made.select(BUCKET).distinct().collect()}  # no more than there are buckets
        for b in set(range(self.buckets) if touched is None else touched) - full:
            path, fs = self._path(f"data/{BUCKET}={b}")
            fs.delete(path, True)

    def change(self, named: DataFrame, key: Sequence[str], make: Callable[[DataFrame], DataFrame]) -> Store:
        """Put ``make(rows of the buckets that named touches)`` in the place of these rows."""
        if not set(self.by) <= set(key):
            raise ValueError(f"the key {list(key)} lacks columns of the buckets, {self.by}")
        after = self.version
        touched = sorted(r[0] for r in named.select(self.bucket().alias("b")).distinct().collect())  # no more than there are buckets
        if not touched:
            return self
        held = self._rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        # Written first: what is read must not be what is being replaced, if a task runs again.
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        new = make(held)
        try:
            new.write.parquet(path)
        except Exception as e:
            if self.version != after:  # files that were being read are no longer there
                raise Conflict(f"version {after + 1} of {self.root} was made by another writer") from e
            raise
        try:
            return self.commit(self.spark.read.schema(new.schema).parquet(path), after, touched)
        finally:
            staged, fs = self._path(f"staged/{path.rsplit('/', 1)[1]}")
            fs.delete(staged, True)

    # Mutations.

    def insert_if_absent(self, new: DataFrame, key: Sequence[str], order: Column | None = None) -> Store:
        return self.change(new, key, lambda held: insert_if_absent(held, new, key, order))

    def upsert(self, new: DataFrame, key: Sequence[str], order: Column | None = None) -> Store:
        return self.change(new, key, lambda held: upsert(held, new, key, order))

    def replace_groups(self, new: DataFrame, group: Sequence[str]) -> Store:
        return self.change(new, group, lambda held: replace_groups(held, new, group))

    def delete(self, keys: DataFrame, key: Sequence[str]) -> Store:
        return self.change(keys, key, lambda held: without(held, keys, key))

    def purge(self, expired: Column, children: Store, key: Sequence[str]) -> Store:
        """Rows that have expired go, and before them all their children: a run that ends between the
        two leaves expired parents, which the next one finds again."""
        gone = self.read().where(F.coalesce(expired, F.lit(False))).select(*key)
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        gone.write.parquet(path)
        gone = self.spark.read.schema(gone.schema).parquet(path)
        children.delete(gone, key)
        return self.delete(gone, key)

    def backfill(self, values: DataFrame, key: Sequence[str], column: str, batch: int | None = None) -> Store:
        """Rows without a value get that of their key. ``batch`` buckets are a version of their own each, so a
        run that ends early has done its part, and the next one goes on with what still lacks a value."""
        lacking = self._rows().where(F.col(column).isNull()).select(BUCKET).distinct()
        todo = sorted(r[0] for r in lacking.collect())
        step = batch or len(todo) or 1
        for at in range(0, len(todo), step):
            some = values.where(self.bucket().isin(todo[at : at + step]))
            self.change(some, key, lambda held, some=some: backfill(held, some, key, column))
        return self


def same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """The keys are equal; two nulls are."""
    return functools.reduce(operator.and_, [left[c].eqNullSafe(right[f"other_{c}"]) for c in key])


def without(held: DataFrame, named: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key, nulls included, is not named."""
    other = named.select(*[F.col(c).alias(f"other_{c}") for c in key]).distinct()
    return held.join(other, same(held, other, key), "left_anti")


def one_of_each(rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """Of rows that share a key the last one in ``order``, and of these the least by all columns: reruns agree."""
    whole = F.struct(*rows.columns)
    if order is None:
        return rows.groupBy(*key).agg(F.min(whole).alias("kept_row")).select("kept_row.*")
    placed = F.max_by(whole, F.struct(order.alias("a"), (-F.xxhash64(*rows.columns).cast("decimal(20)")).alias("b")))
    return rows.groupBy(*key).agg(placed.alias("kept_row")).select("kept_row.*")


def insert_if_absent(held: DataFrame, new: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows already there are never changed; of new rows that share a key, one is taken."""
    once = one_of_each(new.select(*held.columns), key, order) if order is None else one_of_each(new, key, order).select(*held.columns)
    return held.unionByName(without(once, held, key))


def upsert(held: DataFrame, new: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """New rows take the place of those with their key."""
    once = one_of_each(new.select(*held.columns), key, order) if order is None else one_of_each(new, key, order).select(*held.columns)
    return without(held, once, key).unionByName(once)


def replace_groups(held: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """All rows of the groups that the new rows name are replaced: a page of a document, or a strategy."""
    return without(held, new, group).unionByName(new.select(*held.columns))


def purge(held: DataFrame, expired: Column, children: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have expired go, with all their children. A null condition keeps a row."""
    gone = F.coalesce(expired, F.lit(False))
    return held.where(~gone), without(children, held.where(gone), key)


def backfill(held: DataFrame, values: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Rows without a value get that of their key, if there is one; rows that have one are left alone."""
    own = [*key, column]
    once = one_of_each(values.select(*own).where(F.col(column).isNotNull()), key)
    names = {c: f"other_{c}" for c in own}
    taken = set(held.columns)
    if taken & set(names.values()):
        raise ValueError(f"a table cannot have columns {sorted(taken & set(names.values()))}")
    once = once.select(*[F.col(c).alias(n) for c, n in names.items()])
    filled = held.join(once, same(held, once, key), "left").withColumn(column, F.coalesce(F.col(column), F.col(names[column])))
    return filled.select(*held.columns)


def counters(held: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(seen, added)``: rows of a batch, and those whose key the store lacks."""
    added = new.select(*key).distinct().join(held.select(*key), list(key), "left_anti").agg(F.count("*").alias("added"))
    return new.agg(F.count("*").alias("seen")).crossJoin(added)


def bulk_errors(results: DataFrame, status: str = "status", by: Sequence[str] = ()) -> DataFrame:
    """``(total, failed)``, for each value of ``by``: results of a bulk write; a status of 300 or more, or none, has failed."""
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(status).isNull() | (F.col(status) >= 300)).alias("failed"))


def raise_on_errors(results: DataFrame, status: str = "status") -> None:
    row = bulk_errors(results, status).first()
    if row["failed"]:
        raise RuntimeError(f"{row['failed']} of {row['total']} rows were not written")


def markdown_report(rows: DataFrame, title: str, columns: Sequence[str], path: str) -> DataFrame:
    """A Markdown table of a summary, in the order of its first column, written as text and returned as lines."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("not run")) for c in columns])
    body = rows.select(F.col(columns[0]).alias("place"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
    head = [f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    top = rows.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "no int, value string")
    lines = top.select("no", F.lit(None).cast(body.schema["place"].dataType).alias("place"), "value").unionByName(body.select(F.lit(len(head)).alias("no"), "place", "value"))
    lines = lines.repartition(1).sortWithinPartitions("no", "place", "value").select("value")  # a summary: a row for each configuration
    lines.write.mode("overwrite").text(path)
    return rows.sparkSession.read.option("wholetext", True).text(path).select(F.explode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("value"))


def dump(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write tables as compressed JSON lines, with a manifest ``(name, ddl, n, checksum)`` that is written last.

    The checksum does not depend on the order of rows. A folder without a manifest is no whole dump.
    """
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.option("compression", "gzip").option("ignoreNullFields", False).json(f"{folder}/{name}")
        n, checksum = df.agg(F.count("*"), row_checksum(df)).first()
        rows.append((name, df.schema.json(), n, checksum))
    manifest = spark.createDataFrame(rows, "name string, schema string, n long, checksum string")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def row_checksum(df: DataFrame) -> Column:
    """The exclusive-or of the rows' hashes, and their sum, as text: equal for equal rows in any order, repeats included."""
    value = F.xxhash64(*df.columns)
    return F.concat_ws(":", F.coalesce(F.bit_xor(value), F.lit(0)).cast("string"), F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0)).cast("string"))


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a whole dump, read by their own schemas; a table that lacks rows, or has others, is an error."""
    out = {}
    for m in spark.read.json(f"{folder}/manifest", schema="name string, schema string, n long, checksum string").collect():
        held = spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).json(f"{folder}/{m['name']}")
        n, checksum = held.agg(F.count("*"), row_checksum(held)).first()
        if (n, checksum) != (m["n"], m["checksum"]):
            raise ValueError(f"{m['name']} has {n} rows of {m['n']}, or not the same ones")
        out[m["name"]] = held
    return out


def cached_table(spark: SparkSession, root: str, seconds: float, now: float, make: Callable[[], DataFrame]) -> DataFrame:
    """A small table that is made anew once it is ``seconds`` old; entries are folders named by the time they were made.

    Of two that make one at a time both may be written, which are alike; a reader takes the newest whole one.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    made = [int(s.getPath().getName()) for s in fs.listStatus(path) if whole(s.getPath())] if fs.exists(path) else []
    fresh = [t for t in made if 0 <= now - t / 1000 < seconds]
    at = max(fresh, default=int(now * 1000))
    if not fresh:
        make().write.mode("overwrite").parquet(f"{root}/{at}")
    return spark.read.parquet(f"{root}/{at}")
