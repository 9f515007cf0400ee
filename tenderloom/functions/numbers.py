"""Numbers as columns: rates, shares, scores, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of base units that prices may be divided by, of packages, and of a single piece.
MEASURES = ("006", "055", "113", "166", "112")
PACKAGES = ("778", "736", "704", "839")
PIECE = "796"


def laplace(wins: Column, count: Column) -> Column:
    return (wins + 1.0) / (count + 2.0)


def saturation(count: Column, half: float) -> Column:
    return count / (count + F.lit(half))


def clamp(c: Column) -> Column:
    """Into [0, 1]; what is no finite number is 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.when(whole > 0, part / whole)


def decimal_of(c: Column) -> Column:
    """A price written with blanks or a comma, at least 0; else null."""
    value = F.regexp_replace(F.regexp_replace(c, "[\\s ]", ""), ",", ".").try_cast("decimal(18,4)")
    return F.when(value >= 0, value)


def unit_price(price: Column, base: Column, code: Column, factor: Column, pack: Column) -> tuple[Column, Column]:
    """(price a base unit, its code): measures by their factor, packages by what they hold, else as it is.

    Rounded half to even at four digits.
    """
    measure = base.isin(*MEASURES)
    packed = code.isin(*PACKAGES) & (pack > 0)
    value = F.when(measure & (factor > 0), price / factor).when(~measure & packed, price / pack).when(~measure, price)
    unit = F.when(value.isNull(), F.lit("")).when(~measure & packed, F.lit(PIECE)).otherwise(base)
    return F.bround(value, 4), F.coalesce(unit, F.lit(""))
