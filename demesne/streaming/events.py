"""Structured Streaming over the events table: windows, sessions, de-duplication, state.

Streams are an extension: files are the source, ``availableNow`` drains what is
there, and results go to a table in the shared folder of the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demesne.runtime import ensure_checkpoint_dir

LATE = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a path without one must be a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table of its own and returns the table.

    With append mode, windows still open at the end are left out; complete mode
    keeps them.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(_overwrite(f"{base}/out"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _overwrite(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def sync_chunks(updates: DataFrame, apply: Callable[[DataFrame, int], None], state: str):
    """Incremental sync: each micro-batch of changed chunks is handed to ``apply`` once per batch id."""
    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
