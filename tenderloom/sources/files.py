"""Files as DataFrames: archive and notice CSVs, XML feeds and registries, pages, JSON lines, vectors."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions import identity
from tenderloom.functions.numbers import decimal_of
from tenderloom.functions.text import collapse, inn, json_ld
from tenderloom.operators.quality import validate

# Columns that each archive table must have.
ARCHIVE = {
    "notices": ["lot_id", "procedure_id", "publish_date", "procedure_name", "subject", "start_price", "customer_inn", "is_smp", "is_eshop_or_aisgz"],
    "suppliers": ["lot_id", "supplier_inn", "supplier_kpp", "is_winner"],
    "products": ["lot_id", "product_name", "okpd2_code"],
}
#: Characters of one line at most.
LONGEST_LINE = 16 * 1024 * 1024


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def archive_table(spark: SparkSession, path: str, role: str) -> DataFrame:
    """One role's CSV: semicolons, a header, every column text, a byte order mark stripped; malformed rows end the job."""
    df = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).option("mode", "FAILFAST").option("escape", '"').option("maxCharsPerColumn", LONGEST_LINE).csv(path)
    return require(df.toDF(*[c.replace("﻿", "").strip() for c in df.columns]), ARCHIVE[role])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files in ZIPs; folders are ignored, a name given twice ends the job.

    Each archive is opened by the task that reads it; pointers of large-file stores are refused.
    """

    def members(frames):
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                seen: set[str] = set()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = info.filename.replace("\\", "/").rpartition("/")[2]
                        if info.is_dir() or not name:
                            continue
                        data = z.read(info)
                        if name in seen or data.startswith(b"version https://git-lfs"):
                            raise ValueError(f"{archive}: {name} is repeated or a pointer")
                        seen.add(name)
                        yield pd.DataFrame({"archive": [archive], "name": [name], "content": [data]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, content binary")


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of a notice file by its first bytes; what is no text is refused."""
    if head[:2] in (b"PK", b"\xd0\xcf") or b"\0" in head:
        raise ValueError("not a text file")
    try:
        line, encoding = head.decode("utf-8-sig").split("\n", 1)[0], "utf-8-sig"
    except UnicodeDecodeError:
        line, encoding = head.decode("cp1251").split("\n", 1)[0], "cp1251"
    return encoding, max(",;\t", key=line.count)


def notice_csv(spark: SparkSession, path: str) -> DataFrame:
    """A notice or item file in either encoding and with any of three separators, all text, blank rows dropped."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    head = bytes(raw.select(F.substring("content", 1, 65536).alias("h")).first()["h"])
    encoding, sep = sniff(head.rsplit(b"\n", 1)[0])

    def lines(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"line": bytes(content).decode(encoding).splitlines()})

    names = [c.strip() for c in next(csv.reader([head.decode(encoding, "ignore").splitlines()[0]], delimiter=sep))]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = raw.mapInPandas(lines, "line string").filter(F.col("line") != F.lit(head.decode(encoding, "ignore").splitlines()[0]))
    df = rows.select(F.from_csv("line", schema, {"sep": sep, "escape": '"'}).alias("r")).select("r.*")
    return df.filter(F.concat_ws("", *[F.trim(c) for c in df.columns]) != "")


def checked_notices(df: DataFrame) -> DataFrame:
    """Typed notices with ``issues``: bad or repeated lot ids, no or too long title, bad tax number, price or region."""
    require(df, ["lot_id", "procedure_name"])
    text = lambda c: F.coalesce(collapse(F.col(c)), F.lit("")) if c in df.columns else F.lit("")
    rows = df.select(
        text("lot_id").alias("lot_id"),
        F.coalesce(F.nullif(text("procedure_name"), F.lit("")), text("subject")).alias("title"),
        text("customer_inn").alias("customer_inn"),
        text("start_price").alias("raw_price"),
        text("delivery_region").alias("region"),
    )
    rows = rows.withColumn("start_price", decimal_of(F.col("raw_price"))).withColumn("_n", F.count("*").over(Window.partitionBy("lot_id")))
    rules = {
        "lot_id": F.col("lot_id").rlike(r"^[0-9A-Za-z_-]{1,128}$"),
        "lot_id_repeated": F.col("_n") == 1,
        "title": F.length("title").between(1, 4000),
        "customer_inn": F.col("customer_inn").rlike(r"^(|[0-9]{10}|[0-9]{12})$"),
        "start_price": (F.col("raw_price") == "") | F.col("start_price").isNotNull(),
        "region": F.col("region").rlike(r"^(|[0-9]{2})$"),
    }
    return validate(rows, rules).drop("_n", "raw_price")


def attach_items(notices: DataFrame, items: DataFrame) -> DataFrame:
    """Notices with ``positions``, their items in file order; an item of no notice ends the job.

    An item's id is a hash of lot, name and code with its ordinal among equal items.
    """
    require(items, ["lot_id", "product_name", "okpd2_code"])
    clean = items.select(*[F.coalesce(collapse(F.col(c)), F.lit("")).alias(c) for c in ("lot_id", "product_name", "okpd2_code")], F.monotonically_increasing_id().alias("at"))
    same = Window.partitionBy("lot_id", "product_name", "okpd2_code").orderBy("at")
    named = clean.withColumn("item_id", identity.item_id(F.col("lot_id"), F.col("product_name"), F.col("okpd2_code"), F.row_number().over(same)))
    known = notices.select("lot_id", F.lit(True).alias("_known"))
    checked = named.join(known, "lot_id", "left").withColumn("lot_id", F.when(F.col("_known"), F.col("lot_id")).otherwise(F.raise_error(F.concat(F.lit("unknown lot "), F.col("lot_id")))))
    lists = checked.groupBy("lot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item_id", "product_name", "okpd2_code"))), lambda x: F.struct(x["item_id"].alias("item_id"), x["product_name"].alias("name"), x["okpd2_code"].alias("okpd2"))).alias("positions"))
    return notices.join(lists, "lot_id", "left")


def precheck(df: DataFrame, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """(issue, n) over all rows and the first ``shown`` rows, for a look before an upload; nothing fails."""
    checked = checked_notices(df)
    return checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")), df.limit(shown)


def supplier_dataset(df: DataFrame, column: str = "inn") -> DataFrame:
    """Distinct companies by their repaired tax number; rows without a valid one are dropped."""
    return df.withColumn("inn", inn(F.col(column))).filter("inn is not null").dropDuplicates(["inn"])


OFFER = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("_available", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("url", "name", "typePrefix", "vendor", "model", "price", "currencyId", "categoryId", "description", "vendorCode")],
        T.StructField("param", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_name", T.StringType())]))),
    ]
)
CATEGORY = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("_parentId", T.StringType())])


def product_feed(spark: SparkSession, path: str) -> DataFrame:
    """Offers of an XML product feed with their category's name and parameters; offers with neither id nor url are dropped."""
    offers = spark.read.format("xml").option("rowTag", "offer").schema(OFFER).load(path)
    names = spark.read.format("xml").option("rowTag", "category").schema(CATEGORY).load(path).select(F.col("_id").alias("categoryId"), F.trim("_VALUE").alias("source_category"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), collapse(F.concat_ws(" ", "typePrefix", "vendor", "model")))
    parameters = F.map_from_entries(F.filter(F.transform(F.coalesce("param", F.array().cast(OFFER["param"].dataType)), lambda p: F.struct(p["_name"].alias("key"), F.trim(p["_VALUE"]).alias("value"))), lambda e: e["key"].isNotNull()))
    rows = offers.filter(F.coalesce("_id", F.lit("")).cast("string").rlike(r"\S") | F.coalesce("url", F.lit("")).rlike(r"\S"))
    return rows.join(F.broadcast(names.dropDuplicates(["categoryId"])) if names.limit(100_001).count() <= 100_000 else names.dropDuplicates(["categoryId"]), "categoryId", "left").select(
        identity.external_id(F.col("_id"), F.col("url"), name).alias("external_id"),
        F.col("url"),
        name.alias("name"),
        F.coalesce("vendor", F.lit("")).alias("brand"),
        F.coalesce("vendorCode", F.lit("")).alias("article"),
        decimal_of(F.col("price")).alias("price"),
        F.coalesce("currencyId", F.lit("")).alias("currency"),
        F.coalesce("source_category", F.lit("")).alias("source_category"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.when(F.lower("_available") == "false", "on_order").when(F.lower("_available") == "true", "available").otherwise("unknown").alias("availability"),
        parameters.alias("attributes"),
    )


def registry_dump(spark: SparkSession, path: str, row: str, fields: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """Companies of an XML registry: ``fields`` maps inn, registry_date, main_okved, reported_okved, region to columns.

    Rows without number or date are dropped; the main activity is the registry's, else the reported one, which is told.
    """
    raw = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    c = {k: F.nullif(F.trim(F.col(v).cast("string")), F.lit("")) for k, v in fields.items()}
    out = raw.select(
        c["inn"].alias("inn"),
        F.coalesce(c["registry_date"].try_cast("date"), F.try_to_date(c["registry_date"], "dd.MM.yyyy")).alias("registry_date"),
        F.coalesce(c["main_okved"], c["reported_okved"]).alias("okved"),
        (c["main_okved"].isNull() & c["reported_okved"].isNotNull()).alias("okved_reported"),
        F.lpad(c["region"], 2, "0").alias("region"),
    )
    return out.filter("inn is not null and registry_date is not null")


def page_products(pages: DataFrame, kinds: Sequence[str] = ("Product", "Offer")) -> DataFrame:
    """Things of the given types in the JSON-LD of pages (url, html): lists and graphs flattened, broken blocks skipped."""
    one = pages.select("url", F.explode(json_ld(F.col("html"))).alias("block"))
    listed = F.when(F.col("block").rlike(r"^\s*\["), F.col("block")).otherwise(F.coalesce(F.get_json_object("block", "$.@graph"), F.concat(F.lit("["), F.col("block"), F.lit("]"))))
    things = one.select("url", F.explode(F.from_json(listed, "array<string>")).alias("thing"))
    get = lambda *paths: F.coalesce(*[F.get_json_object("thing", p) for p in paths], F.lit(""))
    return things.filter(F.get_json_object("thing", "$.@type").isin(list(kinds))).select(
        "url",
        get("$.name").alias("name"),
        get("$.brand.name", "$.brand").alias("brand"),
        get("$.sku", "$.productID").alias("sku"),
        decimal_of(get("$.offers.price", "$.price", "$.offers[0].price")).alias("price"),
        F.regexp_extract(get("$.offers.availability", "$.availability"), r"(\w+)$", 1).alias("availability"),
    )


def sitemap_entries(pages: DataFrame) -> DataFrame:
    """(url, location, nested) of sitemap files (url, content): nested locations are further sitemaps."""
    found = F.regexp_extract_all("content", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return pages.select("url", F.explode(found).alias("location"), F.col("content").contains("<sitemapindex").alias("nested"))


def expand_sitemaps(files: DataFrame, roots: DataFrame, most_depth: int = 2) -> DataFrame:
    """(root, location): the pages that the sitemaps (root) lead to, through nested ones down to ``most_depth``.

    ``files`` (url, content) holds what could be fetched; a file with null content or without a sitemap's root element
    could not be read. An unreadable root is an error; a nested one only lacks its part. No file is read twice for a root.
    """
    read = files.filter(F.col("content").rlike("<(urlset|sitemapindex)[ >]"))
    asked = roots.select("root").filter("root is not null").distinct()
    broken = asked.join(read.select(F.col("url").alias("root")), "root", "left_anti").limit(3).collect()
    if broken:
        raise ValueError(f"unreadable sitemaps: {', '.join(r['root'] for r in broken)}")
    entries = sitemap_entries(read).distinct()
    frontier = asked.withColumn("url", F.col("root"))
    seen, out = frontier, None
    for depth in range(most_depth + 1):
        found = frontier.join(entries, "url")
        pages = found.filter("not nested").select("root", "location")
        out = pages if out is None else out.unionByName(pages)
        if depth < most_depth:
            frontier = found.filter("nested").select("root", F.col("location").alias("url")).distinct().join(seen, ["root", "url"], "left_anti")
            seen = seen.unionByName(frontier)
    return out.distinct()


def balanced_sample(urls: DataFrame, per_category: int) -> DataFrame:
    """URLs (url, root, subcategory, ordinal): a URL belongs to the first root that lists it; a root's quota is filled
    in turns over its subcategories."""
    own = urls.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("ordinal"))).filter("_n = 1").drop("_n")
    deep = own.withColumn("depth", F.row_number().over(Window.partitionBy("root", "subcategory").orderBy("ordinal")))
    return deep.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("depth", "subcategory"))).filter(F.col("_n") <= per_category).drop("_n", "depth")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line, blank lines skipped, a broken line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def dictionary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reference file that holds one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed, however long the list."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def eligible(lots: DataFrame, before: Column) -> DataFrame:
    """Lots of a prepared archive that may be loaded: dated before the cut, without conflicting versions."""
    return lots.filter((F.col("publish_date") < before) & ~F.col("notice_conflict"))
