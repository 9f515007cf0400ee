"""Classification of offers: a cascade of channels, code levels, rubrics, item types, market roles.

Dictionaries come in as DataFrames. Prefix matches are equi-joins on the exploded prefixes of the code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import find_sequence, fold, stems
from tenderloom.operators.state import first_of_each

# Confidence of each channel, strongest first.
CHANNELS = {"gold": 1.0, "reference": 0.9, "archive": 0.8, "source_map": 0.7, "lexicon": 0.6}
CODE = r"^\d{2}(\.\d{1,2}(\.\d{1,2}(\.\d{3})?)?)?$"


def is_code(c: Column) -> Column:
    return c.rlike(CODE)


def level(c: Column) -> Column:
    """Digits in the code."""
    return F.length(F.translate(c, ".", ""))


def cascade(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``code``, ``method``, ``confidence`` of the strongest channel whose column holds a well-formed code."""
    options = [F.when(is_code(F.col(columns[ch])), F.struct(F.col(columns[ch]).alias("code"), F.lit(ch).alias("method"), F.lit(conf).alias("confidence"))) for ch, conf in CHANNELS.items() if ch in columns]
    best = F.coalesce(*options, F.struct(F.lit("").alias("code"), F.lit("none").alias("method"), F.lit(0.0).alias("confidence")))
    return df.withColumn("_best", best).select("*", "_best.code", "_best.method", "_best.confidence").drop("_best")


def unambiguous(pairs: DataFrame, name: str, code: str) -> DataFrame:
    """(name, code) of folded names that stand for one code only."""
    return pairs.groupBy(fold(F.trim(name)).alias(name)).agg(F.min(code).alias(code), F.count_distinct(code).alias("_n")).filter("_n = 1").drop("_n")


def code_names(codes: DataFrame, names: DataFrame) -> DataFrame:
    """``name`` of the nearest known level: the whole code, then five characters, then two."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), p.alias("prefix")) for i, p in enumerate((F.col("code"), F.left("code", F.lit(5)), F.left("code", F.lit(2))))])).alias("s")
    hits = codes.select("code", steps).select("code", "s.step", "s.prefix").join(names.select(F.col("code").alias("prefix"), "name"), "prefix")
    best = hits.groupBy("code").agg(F.min_by("name", "step").alias("name"))
    return codes.join(best, "code", "left")


def source_categories(offers: DataFrame, mapping: DataFrame) -> DataFrame:
    """The code a provider's own category stands for: (provider, folded category)."""
    m = mapping.select("provider", fold(F.trim("category")).alias("_category"), F.col("code").alias("mapped_code"))
    return offers.withColumn("_category", fold(F.trim("category"))).join(m, ["provider", "_category"], "left").drop("_category")


def head_phrase(offers: DataFrame, phrases: DataFrame, key: str, name: str, head: int = 4) -> DataFrame:
    """The phrase that starts earliest among an offer's first stems, the longest of those: (key, phrase, code).

    An offer meets only the phrases that begin with one of its first stems.
    """
    p = phrases.select("phrase", "code", stems(F.col("phrase")).alias("needle")).filter("size(needle) > 0").withColumn("stem", F.col("needle")[0])
    o = offers.select(key, F.slice(stems(F.col(name)), 1, head).alias("heads"))
    met = o.select(key, "heads", F.explode(F.array_distinct("heads")).alias("stem")).join(p, "stem")
    hits = met.withColumn("at", find_sequence(F.col("heads"), F.col("needle"))).filter("at >= 0")
    return first_of_each(hits, [key], [F.asc("at"), F.desc(F.size("needle")), F.asc("phrase")]).select(key, "phrase", "code")


def longest_prefix(codes: DataFrame, entries: DataFrame, code: str, prefix: str, value: str) -> DataFrame:
    """The value of the longest entry that the code equals or continues after a dot."""
    parts = F.split(F.col(code), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = codes.select(code, F.explode(F.array_distinct(prefixes)).alias(prefix)).distinct().join(entries.select(prefix, value), prefix)
    best = each.groupBy(code).agg(F.max_by(value, F.length(prefix)).alias(value))
    return codes.join(best, code, "left")


def item_type(code: Column, name: Column, by_class: dict[str, str], phrases: Sequence[tuple[str, str]]) -> Column:
    """By the code's class, else by the longest phrase the name starts with, else unknown."""
    kind = F.lit("unknown")
    for phrase, t in sorted(phrases, key=lambda p: len(p[0])):
        kind = F.when(fold(F.trim(name)).startswith(phrase), t).otherwise(kind)
    for cls, t in by_class.items():
        kind = F.when(F.left(code, F.lit(2)) == cls, t).otherwise(kind)
    return kind


def market_role(companies: DataFrame, roles: DataFrame) -> DataFrame:
    """Manufacturer where products are declared, else the role of the longest digit prefix of the main activity."""
    digits = F.translate("okved", ".", "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda n: F.left(digits, n))
    each = companies.select("inn", F.explode(prefixes).alias("prefix")).join(roles.select("prefix", "role"), "prefix")
    best = each.groupBy("inn").agg(F.max_by("role", F.length("prefix")).alias("role"))
    return companies.join(best, "inn", "left").withColumn("role", F.when(F.col("declared_products") > 0, "manufacturer").otherwise(F.coalesce("role", F.lit("unknown"))))
