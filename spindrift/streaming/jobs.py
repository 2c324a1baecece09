"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spindrift.session import WRITTEN


def tumbling_counts(events: DataFrame, time_col: str, key: str, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls of each key in each window, complete once the watermark has passed it."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window), key).count()


def ingest_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> DataStreamWriter:
    """Append rows whose key the target table (Parquet) does not have; a batch that runs again adds nothing."""

    def store(batch: DataFrame, _: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates([key])
        try:
            held = spark.read.parquet(target).select(key)
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            rows = rows.join(held, key, "left_anti")
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drain(spark: SparkSession, source: str, schema, folder: str, build) -> str:
    """Run a file stream to its end; returns the path of what ``build(stream, path, checkpoint)`` writes."""
    at = f"{folder}/{uuid.uuid4().hex}"
    WRITTEN.append(at)
    stream = spark.readStream.schema(schema).parquet(source)
    build(stream, f"{at}/out", f"{at}/state").start().awaitTermination()
    return f"{at}/out"
