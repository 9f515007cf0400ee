"""Writing: versioned appends, verified imports, staged publication, snapshots, exports. Every write can be repeated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.text import csv_cell
from tenderloom.operators.quality import digest


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows in the form of ``like``."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as e:  # noqa: BLE001  the class differs between classic and connect sessions
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], like.schema)
        raise


def append_versions(rows: DataFrame, path: str, at: Column) -> None:
    """Full rows under one version, the microseconds of ``at``."""
    rows.withColumn("version", F.unix_micros(at)).write.mode("append").parquet(path)


def export(df: DataFrame, path: str) -> int:
    """A compressed table and the number of rows read back from it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def verified_import(rows: DataFrame, path: str, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """Append the rows whose key is not there yet, then hold the whole table against ``checks``, which must all be true.

    Run again it adds nothing. Two writers at once may both add a key: a table has one writer at a time. Returns the table.
    """
    spark = rows.sparkSession
    rows.join(existing(spark, path, rows).select(key), key, "left_anti").select(*rows.columns).write.mode("append").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    result = table.agg(*[c.alias(n) for n, c in checks.items()]).first()
    failed = [n for n in checks if not result[n]]
    if failed:
        raise ValueError(f"import failed its checks: {', '.join(failed)}")
    return table


def import_archive(tables: Mapping[str, tuple[DataFrame, str]], root: str, snapshot: str) -> DataFrame:
    """Load several tables in two phases: rows under the snapshot's folder, then its registry row once counts agree.

    A snapshot that is registered with other digests is refused; one that is registered alike is left alone. A root has
    one writer at a time.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    found = None
    for name, (df, key) in tables.items():
        one = digest(df, key).select(F.lit(snapshot).alias("snapshot"), F.lit(name).alias("name"), "*")
        found = one if found is None else found.unionByName(one)
    want = {r["name"]: r for r in found.collect()}
    registry = existing(spark, f"{root}/registry", found)
    known = {r["name"]: r for r in registry.filter(F.col("snapshot") == snapshot).collect()}
    if known and known != want:
        raise ValueError("the snapshot is registered with other contents")
    if not known:
        for name, (df, key) in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/{snapshot}/{name}")
            got = digest(spark.read.schema(df.schema).parquet(f"{root}/{snapshot}/{name}"), key).first()
            if (got["n"], got["digest"]) != (want[name]["n"], want[name]["digest"]):
                raise ValueError(f"{name} was not written whole")
        spark.createDataFrame(list(want.values()), found.schema).write.mode("append").parquet(f"{root}/registry")
    return spark.read.schema(found.schema).parquet(f"{root}/registry")


def publish_run(rows: DataFrame, root: str, run: str, key: str, expected: int, at: Column) -> None:
    """Rows become visible by their run's publication row, which is written only if their number is right."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/rows/run_id={run}")
    n = spark.read.parquet(f"{root}/rows/run_id={run}").agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if not n["n"] == n["d"] == expected:
        raise ValueError(f"run {run}: {n['n']} rows, {n['d']} keys, {expected} expected")
    spark.range(1).select(F.lit(run).alias("run_id"), at.alias("completed_at")).write.mode("append").parquet(f"{root}/published")


def snapshot(df: DataFrame, scope: str, definitions: int, at: Column, most: int = 100_000) -> DataFrame:
    """A slice as one JSON row under an id made of scope and time, so that publishing it again replaces it.

    A slice is a report: one of more than ``most`` rows is an error, since one value holds it.
    """
    rows = df.limit(most + 1).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("rows"))
    payload = F.when(F.size("rows") <= most, F.to_json("rows")).otherwise(F.raise_error(F.lit("a snapshot holds a report, not a table")))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(scope), F.lit(definitions), at.cast("string")), 256).alias("snapshot_id"), F.lit(scope).alias("scope_key"), F.lit(definitions).alias("definitions"), at.alias("as_of"), payload.alias("payload"))


def latest_snapshot(snapshots: DataFrame, definitions: int) -> DataFrame:
    """The newest snapshot of each scope under one version of the definitions."""
    rows = snapshots.filter(F.col("definitions") == definitions)
    return rows.groupBy("scope_key").agg(F.max_by(F.struct("snapshot_id", "as_of", "payload"), F.struct("as_of", "snapshot_id")).alias("s")).select("scope_key", "s.*")


def retire(table: DataFrame, loaded: str = "registry_date") -> DataFrame:
    """A registry without the companies that its newest full load no longer names."""
    newest = table.agg(F.max(loaded).alias(loaded))
    return table.join(F.broadcast(newest), loaded, "left_semi")


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Export lines: semicolons, cells that no spreadsheet takes for formulas."""
    return df.select(F.concat_ws(";", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


def product_lines(lots: DataFrame) -> DataFrame:
    """Lots with candidate arrays flattened for export: a row a lot and candidate, shortlisted ones only."""
    rows = lots.select("lot_id", "title", F.explode("candidates").alias("c")).filter("c.shortlisted")
    return rows.select("lot_id", "title", "c.inn", "c.name", "c.score")


def run_journal(runs: DataFrame, path: str) -> None:
    """Finished runs; a run told twice has the same version and is one row when read by key."""
    runs.withColumn("version", F.unix_micros("started_at")).write.mode("append").parquet(path)
