"""Checks on data: constraints, digests of repeated passes, manifests, equal sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``issues``, the names of the rules a row breaks; a rule that cannot be judged is broken."""
    return df.withColumn("issues", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda i: i.isNotNull()))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("issues") == 0).drop("issues")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("issues") > 0)


def issue_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def digest(df: DataFrame, key: str) -> DataFrame:
    """(n, distinct_n, digest) of a pass, whatever its order: sums of 64-bit hashes as decimals."""
    one = lambda salt: F.sum(F.xxhash64(F.col(key), F.lit(salt)).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_n"), F.sha2(F.concat_ws(":", one(1).cast("string"), one(2).cast("string")), 256).alias("digest"))


def same_pass(first: DataFrame, second: DataFrame, key: str, expected: int) -> bool:
    """Two passes gave the same keys, none twice, as many as the source says."""
    a, b = digest(first, key).first(), digest(second, key).first()
    return a == b and a["n"] == a["distinct_n"] == expected


def table_manifest(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, n, distinct_n, digest) of each (table, key)."""
    out = None
    for name, (df, key) in tables.items():
        one = digest(df, key).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows, as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
