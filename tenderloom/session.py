"""The Spark session used by tests, the benchmark and interactive work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tenderloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
