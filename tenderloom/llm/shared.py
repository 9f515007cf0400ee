"""What the operators of this package share: the shared folder, table reads, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, whose driver and tasks are one process, may lack that setting and gets a temporary folder;
    on a cluster a missing one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tenderloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables of one job in the shared folder, so that no step is worked out twice or lost with an executor.

    What is read no more is dropped; tables that a returned DataFrame still reads stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}

    def write(self, name: str, df: DataFrame, rows: int = 1000) -> DataFrame:
        """Write ``df`` and read it back. While it is written, batches for Python hold at most ``rows`` rows of what may be texts."""
        path = shared_folder(self.spark, f"{self.job}-{name}")
        with few_rows(self.spark, rows):
            df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, []):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """One table of its own: ``df`` written to the shared folder and read back."""
    return Tables(df.sparkSession, "table").write(name, df)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """At most ``rows`` rows a batch for Python tasks in jobs that run meanwhile; then the session's own number again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions for keyed repartitioning: the session's own shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id written as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


#: So many groups are few enough to send to every task.
FEW_GROUPS = 100_000


def beside_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row for each ``key`` and ``__n``, its number of rows; nulls together.

    Few groups are sent to every task, so that a common key stays spread. Of many, those with more than a
    ``FEW_GROUPS``-th of all rows are few again, and only the others are joined by shuffle. ``__n`` stays.
    """
    groups = groups.withColumnRenamed(key, "__key")
    same = F.col(key).eqNullSafe(F.col("__key"))
    if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), same).drop("__key")
    least = (groups.agg(F.sum("__n")).first()[0] or 0) / FEW_GROUPS
    first = rows.join(F.broadcast(groups.filter(F.col("__n") > least)), same, "left")
    rest = first.filter("__n IS NULL").select(*rows.columns).join(groups.filter(F.col("__n") <= least), same)
    return first.filter("__n IS NOT NULL").unionByName(rest).drop("__key")
