"""Queries of compact cards over the prepared archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.operators import cards, history
from tenderloom.plans import mapping as m
from tenderloom.plans.archive import Archive

VISIBLE = 120


def _examples(spark, d):
    a = Archive(spark, d)
    return cards.examples(history.past(a.dossiers.filter("known"), m.CUT))


def card_examples(spark, d):
    """The five latest different purchases of each supplier and category."""
    names = F.coalesce(F.array_join(F.transform("items", lambda i: F.concat(i["name"], F.lit("|"), i["code"])), ","), F.lit(""))
    return _examples(spark, d).select("supplier_inn", "category", "place", "notice", names.alias("items"), "lots")


def compact_cards(spark, d):
    return cards.compact(_examples(spark, d)).select("supplier_inn", "category", "text", F.size("items").alias("products"))


def card_mentions(spark, d):
    """Where each product stands in its card, and what a reader of 120 characters sees of it."""
    return cards.mentions(cards.compact(_examples(spark, d)), VISIBLE).select("supplier_inn", "category", "name", "begin", "end", "seen")


QUERIES = {f.__name__: f for f in (card_examples, compact_cards, card_mentions)}

_C = "WITH" + m.ARCHIVE_SQL + """,
i0 AS (SELECT lot_id, category, left(product_name, 200) AS name, min(coalesce(okpd2_code, '')) AS code FROM ware WHERE product_name IS NOT NULL GROUP BY ALL),
i1 AS (SELECT * FROM i0 QUALIFY row_number() OVER (PARTITION BY lot_id, category ORDER BY name, code) <= 5),
i2 AS (SELECT lot_id, category, list({'name': name, 'code': code} ORDER BY name, code) AS items, string_agg(name, '; ' ORDER BY name, code) AS named FROM i1 GROUP BY ALL),
h0 AS (SELECT supplier_inn, category, lot_id, publish_date, left(coalesce(query_text, ''), 400) AS notice, coalesce(named, '') AS named, items FROM past JOIN tag USING (lot_id) LEFT JOIN i2 USING (lot_id, category)),
h1 AS (SELECT supplier_inn, category, notice || ' ' || named AS description, max(publish_date) AS last_date, count(DISTINCT lot_id) AS lots, arg_max(notice, (publish_date, -lot_id)) AS notice, arg_max(items, (publish_date, -lot_id)) AS items FROM h0 GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY supplier_inn, category ORDER BY last_date DESC, description) AS place FROM h1 QUALIFY place <= 5),
p0 AS (SELECT supplier_inn, category, place, unnest(items) AS item, unnest(range(len(items))) AS depth FROM ex),
p1 AS (SELECT supplier_inn, category, item, depth, place FROM p0 WHERE trim(item.name) <> '' QUALIFY row_number() OVER (PARTITION BY supplier_inn, category, lower(trim(item.name)) ORDER BY depth, place) = 1),
p2 AS (SELECT *, row_number() OVER (PARTITION BY supplier_inn, category ORDER BY depth, place) AS n FROM p1 QUALIFY n <= 15),
p3 AS (SELECT supplier_inn, category, count(*) AS products, string_agg(item.name || CASE WHEN item.code <> '' THEN ' (ОКПД2 ' || item.code || ')' ELSE '' END, '; ' ORDER BY n) AS said FROM p2 GROUP BY ALL),
n0 AS (SELECT supplier_inn, category, trim(notice) AS notice, place FROM ex WHERE trim(notice) <> '' QUALIFY row_number() OVER (PARTITION BY supplier_inn, category, lower(trim(notice)) ORDER BY place) = 1),
n1 AS (SELECT supplier_inn, category, string_agg(notice, ' ; ' ORDER BY place) AS notices FROM n0 GROUP BY ALL),
cd AS (SELECT k.supplier_inn, k.category, 'Категория ОКПД2: ' || k.category || '.' || coalesce(' Товары и услуги: ' || said || '.', '') || coalesce(' Примеры закупок: ' || notices || '.', '')
  || CASE WHEN said IS NULL AND notices IS NULL THEN ' Недостаточно текстовых примеров.' ELSE '' END AS text, coalesce(products, 0) AS products
  FROM (SELECT DISTINCT supplier_inn, category FROM ex) k LEFT JOIN p3 USING (supplier_inn, category) LEFT JOIN n1 USING (supplier_inn, category))"""

SQL = {
    "card_examples": _C + " SELECT supplier_inn, category, CAST(place AS INTEGER) AS place, notice, coalesce(array_to_string(list_transform(items, lambda i: i.name || '|' || i.code), ','), '') AS items, lots FROM ex",
    "compact_cards": _C + " SELECT supplier_inn, category, text, CAST(products AS INTEGER) AS products FROM cd",
    # Places by construction: the phrase before the products, then each product's length with its code and what parts them.
    "card_mentions": _C + """, o AS (SELECT supplier_inn, category, n, item.name AS name, length('Категория ОКПД2: ' || category || '. Товары и услуги: ')
    + coalesce(sum(length(item.name) + CASE WHEN item.code <> '' THEN length(' (ОКПД2 ' || item.code || ')') ELSE 0 END + 2) OVER (PARTITION BY supplier_inn, category ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p2)
SELECT supplier_inn, category, name, CAST(b AS INTEGER) AS "begin", CAST(b + length(name) AS INTEGER) AS "end", CASE WHEN b + length(name) <= 120 THEN 'full' WHEN b < 120 THEN 'part' ELSE 'none' END AS seen FROM o""",
}
