"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spindrift")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def small_side(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A hint to broadcast a side whose number of rows was counted, if it is small."""
    return F.broadcast(df) if rows <= most else df


def scratch(spark: SparkSession) -> str:
    """The folder that executors share, for stored tables and streams; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


#: Folders that this process has written to the shared folder, for ``clean_up``.
WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's place in the shared folder."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete all tables that queries have written so far; returns their number.

    A query's result reads them, so this comes when the results are no longer needed.
    """
    n = 0
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: a table that is read several times, or a cut in the lineage."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
