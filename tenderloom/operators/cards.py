"""Compact cards of suppliers: products taken in turns from examples, notices, and where each product stands in the text."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The phrases of a card.
CATEGORY = "Категория ОКПД2: "
PRODUCTS = " Товары и услуги: "
NOTICES = " Примеры закупок: "
NO_EXAMPLES = " Недостаточно текстовых примеров."
CODE = " (ОКПД2 "
#: A supplier of more lots is dealt by category too.
BUSY = 100_000
#: Purchases of suppliers in a partition.
PART = 50_000


def _first_of_runs(c: str, *fields: str) -> Column:
    """Of neighbours in the sorted array ``c`` that agree in ``fields`` the first."""
    before = lambda i, f: F.get(c, i - 1)[f]
    return F.filter(c, lambda x, i: (i == 0) | ~reduce(and_, [before(i, f) == x[f] for f in fields]))


def items_of_lots(lots: DataFrame, most: int = 5) -> DataFrame:
    """``lots`` with ``held``, (category, items) of each of ``categories``: up to ``most`` product names of 200 characters out of
    ``wares``, by name and code; of names cut alike the length of the longest source. Categories without a name hold null.

    All happens inside a lot's row; its wares are sorted and passed once, however many they are.
    """
    rest = [c for c in lots.columns if c != "wares"]
    wares = F.filter("wares", lambda w: w["product_name"].isNotNull())
    each = lambda name, f: F.sort_array(F.transform(wares, lambda w: F.struct(w["category"].alias("category"), F.left(w["product_name"], F.lit(200)).alias("name"), f(w).alias(name))))
    rows = lots.select(*rest, each("code", lambda w: F.coalesce(w["okpd2_code"], F.lit(""))).alias("coded"), each("less", lambda w: -F.length(w["product_name"])).alias("sized"))
    rows = rows.select(*rest, *[_first_of_runs(c, "category", "name").alias(c) for c in ("coded", "sized")])
    both = F.zip_with("coded", "sized", lambda a, b: F.struct(a["category"].alias("category"), a["name"].alias("name"), a["code"].alias("code"), (-b["less"]).alias("source_length")))
    rows = rows.select(*rest, both.alias("named"))
    rows = rows.select(*rest, F.filter("named", lambda x, i: (i < most) | (F.get("named", i - most)["category"] != x["category"])).alias("named"))
    starts = F.filter(F.transform("named", lambda x, i: F.when((i == 0) | (F.get("named", i - 1)["category"] != x["category"]), i)), lambda i: i.isNotNull())
    of = lambda c: F.transform(F.filter(F.slice("named", c + 1, F.lit(most)), lambda x: x["category"] == F.get("named", c)["category"]), lambda x: F.struct(x["name"].alias("name"), x["code"].alias("code"), x["source_length"].alias("source_length")))
    rows = rows.select(*rest, F.transform(starts, lambda i: F.struct(F.get("named", i)["category"].alias("category"), of(i).alias("items"))).alias("held"))
    items = rows.schema["held"].dataType.elementType["items"].dataType
    bare = F.transform(F.array_except("categories", F.transform("held", lambda h: h["category"])), lambda c: F.struct(c.alias("category"), F.lit(None).cast(items).alias("items")))
    return rows.withColumn("held", F.concat("held", bare))


def packed(held: Column) -> Column:
    """Categories with their items as one text, to be dealt: nested structs take several times the room of what is in them.

    A category is a list of strings: itself, then name, code and length of the source, if it is not the name's, of every item.
    """
    length = lambda i: F.when(i["source_length"] == F.length(i["name"]), "").otherwise(i["source_length"].cast("string"))
    items = lambda h: F.flatten(F.transform(h["items"], lambda i: F.array(i["name"], i["code"], length(i))))
    return F.to_json(F.transform(held, lambda h: F.concat(F.array(h["category"]), F.coalesce(items(h), F.array().cast("array<string>")))))


def unpacked(text: Column) -> Column:
    """The lists of ``packed``."""
    return F.from_json(text, "array<array<string>>", {"mode": "FAILFAST"})


def items_of(one: Column) -> Column:
    """The items of one category's list; null where it has none."""
    at = lambda i: F.get(one, i)
    item = lambda i: F.struct(at(i).alias("name"), at(i + 1).alias("code"), F.when(at(i + 2) == "", F.length(at(i))).otherwise(at(i + 2).cast("int")).alias("source_length"))
    return F.when(F.size(one) > 1, F.transform(F.sequence(F.lit(1), F.size(one) - 1, F.lit(3)), item))


def examples(lots: DataFrame, most: int = 5) -> DataFrame:
    """(supplier_inn, category, place, notice, items, lots): the latest different purchases of each supplier and category.

    ``lots``: dossiers of the past, one row a lot. What belongs to a lot is found in its row, so rows are dealt once: one for
    each supplier of a lot, with all its categories. Only suppliers of more than ``BUSY`` lots are dealt by category too
    (column ``dealt``), so that none fills a task.
    """
    taken = lots.filter("lot_id is not null").select("lot_id", "publish_date", F.left(F.coalesce("query_text", F.lit("")), F.lit(400)).alias("notice"), F.transform("bids", lambda b: b["supplier_inn"]).alias("who"), "categories", "wares")
    each = taken.select(F.explode("who").alias("supplier_inn")).groupBy("supplier_inn").agg(F.count("*").alias("n"))
    count = each.agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") > BUSY, F.col("supplier_inn"))).alias("busy")).first()
    texts = items_of_lots(taken, most).select("who", "lot_id", "publish_date", "notice", packed(F.col("held")).alias("held"), F.transform("held", lambda h: packed(F.array(h))).alias("apart"))
    rows = texts.select(F.explode("who").alias("supplier_inn"), *texts.columns[1:])
    whom = ["supplier_inn"]
    # Outer generators of what is never empty: of others Spark would infer a filter that works the items out again.
    if count["busy"]:
        whom.append("dealt")
        busy = F.col("supplier_inn").isin(count["busy"])
        rows = rows.withColumn("busy", busy).withColumn("held", F.explode_outer(F.when(busy, F.col("apart")).otherwise(F.array("held"))))
        rows = rows.withColumn("dealt", F.when(F.col("busy"), F.get(F.get(unpacked(F.col("held")), F.lit(0)), F.lit(0))))
    # So many partitions that one is sorted in memory: a row becomes several, of several times its size.
    parts = max(int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(count["rows"] or 0) // PART))
    rows = rows.select(*whom, "lot_id", "publish_date", "notice", "held").repartition(parts, *whom)
    rows = rows.select(*whom, "lot_id", "publish_date", "notice", F.explode_outer(unpacked(F.col("held"))).alias("one"))
    rows = rows.select(*whom, "lot_id", "publish_date", "notice", F.get("one", F.lit(0)).alias("category"), items_of(F.col("one")).alias("items")).filter("category is not null")
    named = F.coalesce(F.array_join(F.transform("items", lambda i: i["name"]), "; "), F.lit(""))
    rows = rows.withColumn("description", F.concat("notice", F.lit(" "), named))
    same = Window.partitionBy(*whom, "category", "description")
    first = F.row_number().over(same.orderBy(F.desc("publish_date"), F.asc("lot_id")))
    one = rows.withColumns({"first": first, "lots": F.count("*").over(same)}).filter("first = 1")
    order = Window.partitionBy(*whom, "category").orderBy(F.desc("publish_date"), F.asc("description"))
    placed = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    items = F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["code"].alias("code"), i["source_length"].alias("source_length"), F.col("lot_id").alias("lot_id")))
    return placed.select(*whom, "category", "place", "notice", items.alias("items"), "lots")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def _keys(names: Column) -> Column:
    """By what the names of an array are told apart."""
    return F.transform(_nfkc_each(names), lambda x: F.trim(F.lower(x)))


def compact(found: DataFrame, most: int = 15) -> DataFrame:
    """(supplier_inn, category, text, items) of examples: a card names up to ``most`` different products, taken in turns
    from its examples, then the examples' different notices."""
    one = ["supplier_inn", "category"]
    keys = [*one, *({"dealt"} & set(found.columns))]
    # A card has few examples of few items: its rows are gathered once, and the rest happens inside the card.
    cards = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "notice", "items"))).alias("all"))
    turns = lambda e: F.transform(e["items"], lambda item, depth: F.struct(depth.alias("depth"), e["place"].alias("place"), item.alias("item")))
    flat = F.transform(F.sort_array(F.flatten(F.transform(F.filter("all", lambda e: e["items"].isNotNull()), turns))), lambda x: x["item"])
    cards = cards.select(*keys, flat.alias("items"), F.transform("all", lambda e: F.trim(e["notice"])).alias("notices"))
    cards = cards.select("*", _keys(F.transform("items", lambda i: i["name"])).alias("item_keys"), _keys(F.col("notices")).alias("notice_keys"))
    first = lambda c, k: F.filter(c, lambda x, i: (F.get(k, i) != "") & (F.array_position(k, F.get(k, i)) == i + 1))
    cards = cards.select(*keys, F.slice(first("items", F.col("item_keys")), 1, most).alias("items"), first("notices", F.col("notice_keys")).alias("notices"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    cards = cards.select(*keys, some("items"), some("notices"))
    named = F.array_join(F.transform("items", lambda i: F.when(i["code"] != "", F.concat(i["name"], F.lit(CODE), i["code"], F.lit(")"))).otherwise(i["name"])), "; ")
    part = lambda phrase, c: F.when(c.isNotNull(), F.concat(F.lit(phrase), c, F.lit("."))).otherwise("")
    nothing = F.when(F.col("items").isNull() & F.col("notices").isNull(), NO_EXAMPLES).otherwise("")
    text = F.concat(F.lit(CATEGORY), "category", F.lit("."), part(PRODUCTS, named), part(NOTICES, F.array_join("notices", " ; ")), nothing)
    return cards.select(*one, text.alias("text"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"))


def mentions(cards: DataFrame, visible: int) -> DataFrame:
    """(supplier_inn, category, name, code, begin, end, seen): where each product of a card stands, looked for behind the one
    before; and whether a reader of ``visible`` characters sees it whole (full), in part, or not (none).

    A card's products are few, so they are placed in one pass over its text.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,code:string,begin:int,end:int>>").alias("found"))

    def place(acc: Column, item: Column) -> Column:
        after = F.call_function("locate", item["name"], F.col("text"), acc["at"] + 1)
        begin = F.when(after > 0, after).otherwise(F.call_function("locate", item["name"], F.col("text"), F.lit(1))) - 1
        end = begin + F.length(item["name"])
        one = F.array(F.struct(item["name"].alias("name"), item["code"].alias("code"), begin.cast("int").alias("begin"), end.cast("int").alias("end")))
        return F.when(begin < 0, acc).otherwise(F.struct(end.cast("int").alias("at"), F.concat(acc["found"], one).alias("found")))

    rows = cards.select("supplier_inn", "category", F.inline(F.aggregate("items", start, place)["found"]))
    return rows.withColumn("seen", F.when(F.col("end") <= visible, "full").when(F.col("begin") < visible, "part").otherwise("none"))
