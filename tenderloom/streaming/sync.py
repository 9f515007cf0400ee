"""Catalogue synchronisation as Structured Streaming jobs over landed files.

A job reads new files in micro-batches, enriches and normalises them, and appends versions. Batches are written with
their id, so that one told twice is one when read. Watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tenderloom.operators.state import current, withdraw_absent


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 32, kind: str = "parquet") -> DataFrame:
    """A stream of files as they land; each batch takes so many at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def once_per_key(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Redelivered events dropped while they are not later than ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sync(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Prepare each micro-batch and write it under its batch id; a batch done again overwrites itself.

    Without ``every`` the job takes what is there and ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finish(versions: DataFrame, keys: list[str], source: Column, observed: Column, complete: bool) -> DataFrame:
    """After a full pass that brought offers, versions that withdraw what it did not bring; else none."""
    now = current(versions, keys, [F.desc("version")], F.col("is_deleted") == 1)
    brought = now.filter(source & (F.col("updated_at") >= observed)).limit(1).count()
    if not complete or not brought:
        return now.limit(0)
    return withdraw_absent(now, source, observed, F.unix_micros(observed))


def counts_by_window(stream: DataFrame, at: str, window: str, late: str, *by: str) -> DataFrame:
    """Events by tumbling window, closed once the watermark passes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def refresh(jobs: list[tuple[str, Callable[[], DataFrame]]], root: str) -> None:
    """Derived tables one after the other, each from what the ones before wrote."""
    for name, job in jobs:
        job().write.mode("overwrite").parquet(f"{root}/{name}")
