"""Current state over append-only versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer partitions, as from a small file; else as it is.

    For work on whole texts, which costs more than to move them once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key in the given order; null keys form one group.

    The rank filter lets Spark keep only the first rows of each key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def current(df: DataFrame, keys: Sequence[str], version: Sequence[Column], deleted: Column) -> DataFrame:
    """The latest version of each key, if that version is not a deletion: a deleted row brings no older one back."""
    return first_of_each(df.withColumn("_gone", deleted), keys, version).filter(~F.col("_gone")).drop("_gone")


def latest_run(rows: DataFrame, published: DataFrame, run: str = "run_id", done: str = "completed_at") -> DataFrame:
    """Rows of the run published last, whose one row is broadcast; none where nothing was published."""
    last = published.agg(F.max_by(run, F.struct(done, run)).alias(run))
    return rows.join(F.broadcast(last), run, "left_semi")


def withdraw_absent(offers: DataFrame, source: Column, observed: Column, floor: Column, *, delete: bool = False) -> DataFrame:
    """New versions of a source's rows not seen since ``observed``: unavailable, or deleted.

    Rows already unavailable (or already deleted) get no further version.
    """
    stale = offers.filter(source & (F.col("updated_at") < observed))
    version = F.greatest(F.col("version") + 1, floor)
    if delete:
        return stale.filter("is_deleted = 0").withColumns({"is_deleted": F.lit(1), "version": version})
    return stale.filter("availability <> 'unavailable'").withColumns({"availability": F.lit("unavailable"), "version": version})


def first_seen(versions: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The earliest sighting over all versions of each key."""
    return versions.groupBy(*keys).agg(F.min(at).alias("first_seen_at"))


def rekey(offers: DataFrame, new_key: Column, keys: Sequence[str]) -> DataFrame:
    """Offers under their recomputed key; colliding ones merge: widest dates, other fields of the last id, and a count."""
    rest = [c for c in offers.columns if c not in {*keys, "external_id", "first_seen_at", "last_seen_at"}]
    return (
        offers.withColumn("external_id", new_key)
        .groupBy(*keys, "external_id")
        .agg(
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
            *[F.max_by(c, "offer_id").alias(c) for c in rest],
            F.count("*").alias("merged"),
        )
    )


def save_package(new: DataFrame, versions: DataFrame, keys: Sequence[str], observed: Column) -> DataFrame:
    """A package's rows ready to append: the last of each key, its first sighting carried over, one observation time."""
    order = [F.desc("last_seen_at"), F.desc("ordinal")]
    rows = first_of_each(new, keys, order).drop("first_seen_at")
    seen = first_seen(versions, keys, "first_seen_at").withColumnRenamed("first_seen_at", "_seen")
    return rows.join(seen, list(keys), "left").withColumn("first_seen_at", F.least(observed, "_seen")).withColumn("last_seen_at", observed).drop("_seen")


def derived_values() -> dict[str, Column]:
    """What the normaliser and the classifier found goes before what the source said."""
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return {
        "okpd2_code": first("classified_code", "source_code"),
        "brand": first("normalized_brand", "source_brand"),
        "article": first("normalized_article", "source_article"),
        "currency": first("normalized_currency", "source_currency"),
    }


def source_code(method: Column, code: Column) -> Column:
    """A stored code is the source's own only if no channel of ours set it."""
    return F.when(method.isin("gold", "none"), code).otherwise(F.lit(""))


def fill_left(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Left-join misses as type defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
