"""Small helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the white space of every word and line rule here.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Rows of an Arrow batch. Texts can be long, so a batch stays small.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of 10,000 long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the actions inside; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a temporary one, in local mode only."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


class Shipped:
    """A broadcast object of one of this package's classes.

    The classes travel with it, so executors need no copy of the package. A worker unpacks the
    object once and keeps it between its tasks.
    """

    def __init__(self, spark: SparkSession, value: object):
        self.local = value
        self.box = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})

    def __getstate__(self) -> dict:
        return {"box": self.box}

    @property
    def value(self):
        held = self.box.value
        if "object" not in held:
            held["object"] = pickle.loads(held["packed"])
        return held["object"]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder, and read it back.

    Parquet keeps it smaller than a checkpoint and lets later reads prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def words_of(data: bytes, block: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size, so that a huge text needs little memory."""
    if len(data) <= block:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + block)
        while end < len(data) and data[end] not in ASCII_SPACE:
            end += 1
        yield data[start:end].split()
        start = end


def record_batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def fold_of(id_col, folds: int):
    """``crc32(doc_id as text) mod folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
