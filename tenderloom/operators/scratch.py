"""Intermediate tables of iterative jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where driver and tasks are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tenderloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables of one job: what is written is read back from files, so that a lost executor costs no earlier step.

    What was shuffled for a table is deleted once the table is written, not some time later.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.base = spark, f"{folder(spark)}/{job}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)
