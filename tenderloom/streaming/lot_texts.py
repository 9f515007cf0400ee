"""Search texts of purchases, kept up to date from append-only logs of their parts.

Three logs hold versions of lots, of their items and of who took part. A text is made of all rows of its lot. A refresh
looks at log rows newer than the last refresh, works out anew only the lots they belong to, from the buckets of the logs
in which these lie, and appends the new texts as versions; a lot that lost its subject or its last participant gets a
version that takes its text back. What is read is the latest version of each lot, equal to a rebuild from all rows.

Versions rise: a row that comes late, with a version below the last refresh, is looked at by the next refresh of
``everything`` only. A deleted row's older versions stay dead. Rows without a lot id go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.text import fold, term_count
from tenderloom.operators.state import current

#: Names of products in a text, at most.
MOST_PRODUCTS = 100
LOGS = {
    "lots": ("lot_id long, subject string, procedure string, version long, deleted int", ["lot_id"]),
    "items": ("lot_id long, item_id long, product_name string, version long, deleted int", ["lot_id", "item_id"]),
    "participations": ("lot_id long, supplier_id long, is_winner boolean, version long, deleted int", ["lot_id", "supplier_id"]),
}
TEXTS = "lot_id long, title string, text string, terms int, participants array<long>, winners array<long>, version long, deleted int"


def lot_texts(lots: DataFrame, items: DataFrame, participations: DataFrame) -> DataFrame:
    """(lot_id, title, text, terms, participants, winners) of current rows; lots without a subject or a participant have none."""
    rows = lots.select("lot_id", "subject", "procedure").unionByName(items.select("lot_id", "product_name"), allowMissingColumns=True)
    rows = rows.unionByName(participations.select("lot_id", "supplier_id", "is_winner"), allowMissingColumns=True)
    found = rows.groupBy("lot_id").agg(
        F.max("subject").alias("subject"),
        F.max("procedure").alias("procedure"),
        F.slice(F.sort_array(F.collect_set("product_name")), 1, MOST_PRODUCTS).alias("products"),
        F.sort_array(F.collect_set("supplier_id")).alias("participants"),
        F.sort_array(F.collect_set(F.when(F.col("is_winner"), F.col("supplier_id")))).alias("winners"),
    )
    procedure = F.coalesce("procedure", F.lit(""))
    text = fold(F.concat("subject", F.lit(" "), procedure, F.lit(" "), F.array_join("products", " ")))
    found = found.filter("subject is not null and size(participants) > 0").withColumn("text", text)
    return found.select("lot_id", F.when(F.col("subject") != "", F.col("subject")).otherwise(procedure).alias("title"), "text", term_count(F.col("text")).alias("terms"), "participants", "winners")


class LotTexts:
    """Logs and texts under ``path``, laid out in ``buckets`` by lot."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, lot: Column) -> Column:
        return F.pmod(F.xxhash64(lot), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001  the reader's own class differs between classic and connect sessions
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], f"{schema}, bucket int")
            raise

    def append(self, log: str, rows: DataFrame) -> None:
        """Versions of one log's rows; ``deleted`` 1 takes the row away."""
        names = [c.split()[0] for c in LOGS[log][0].split(", ")]
        bucketed = rows.select(*names).filter("lot_id is not null").withColumn("bucket", self._bucket(F.col("lot_id")))
        bucketed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{log}")

    def _current(self, log: str, buckets: list[int] | None = None, affected: DataFrame | None = None) -> DataFrame:
        schema, keys = LOGS[log]
        rows = self._table(log, schema)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        if affected is not None:
            rows = rows.join(affected, "lot_id", "left_semi")
        return current(rows, keys, [F.desc("version")], F.col("deleted") == 1)

    def refreshed(self) -> int:
        """The version up to which texts were worked out."""
        return self._table("texts", TEXTS).agg(F.max("version")).first()[0] or 0

    def refresh(self, everything: bool = False) -> int:
        """Bring the texts up to date; returns how many lots were looked at."""
        done = -1 if everything else self.refreshed()
        newer = [self._table(log, schema).filter(F.col("version") > done).select("lot_id", "version", "bucket") for log, (schema, _) in LOGS.items()]
        rows = newer[0].unionByName(newer[1]).unionByName(newer[2])
        version, n = rows.agg(F.max("version"), F.count_distinct("lot_id")).first()
        if not n:
            return 0
        buckets = [r[0] for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
        affected = rows.select("lot_id").distinct()
        made = lot_texts(*[self._current(log, buckets, affected) for log in LOGS]).withColumn("deleted", F.lit(0))
        gone = affected.join(made.select("lot_id"), "lot_id", "left_anti").join(self.read(buckets).select("lot_id"), "lot_id", "left_semi").withColumn("deleted", F.lit(1))
        out = made.unionByName(gone, allowMissingColumns=True).withColumn("version", F.lit(version).cast("long")).withColumn("bucket", self._bucket(F.col("lot_id")))
        out.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/texts")
        return n

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The texts as of the last refresh."""
        rows = self._table("texts", TEXTS)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return current(rows, ["lot_id"], [F.desc("version")], F.col("deleted") == 1).drop("version", "deleted", "bucket")

    def rebuild(self) -> DataFrame:
        """The texts from all rows of the logs."""
        return lot_texts(*[self._current(log) for log in LOGS])
