"""Queries of the tree ranker over the prepared ranker rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tenderloom.operators import retrieval, trees
from tenderloom.operators.scratch import Scratch
from tenderloom.plans import archive

FEATURES = (
    "category_coverage", "log_participations", "log_customer_participations", "log_category_participations", "log_start_price", "log_product_count",
    "win_rate", "customer_win_rate", "category_win_rate", "has_history", "days_since_last", "price_log_distance",
)
#: A stated model: (feature, border) by level, then leaf values and training rows by leaf number.
STATED = (
    ((("win_rate", 0.35), ("log_participations", 2.1), ("price_log_distance", 0.8)), (-0.31, 0.12, -0.05, 0.27, -0.4, 0.02, -0.11, 0.19), (40, 22, 31, 60, 18, 9, 25, 33)),
    ((("category_coverage", 0.5), ("days_since_last", 400.0), ("category_win_rate", 0.4)), (-0.2, 0.25, -0.35, 0.1, -0.08, 0.33, -0.15, 0.05), (30, 44, 12, 20, 28, 61, 7, 36)),
    ((("customer_win_rate", 0.5), ("log_start_price", 11.5), ("win_rate", 0.2)), (-0.07, 0.21, 0.03, -0.14, 0.09, 0.3, -0.02, 0.16), (25, 13, 48, 17, 35, 29, 40, 31)),
    ((("log_customer_participations", 0.3), ("log_category_participations", 1.2), ("has_history", 0.5)), (-0.28, -0.1, -0.17, 0.04, -0.06, 0.13, 0.11, 0.24), (11, 3, 8, 5, 70, 21, 66, 54)),
)


def stated_model() -> trees.Trees:
    return trees.Trees(
        FEATURES,
        np.array([[FEATURES.index(f) for f, _ in s] for s, _, _ in STATED]),
        np.array([[b for _, b in s] for s, _, _ in STATED]),
        np.array([v for _, v, _ in STATED]),
        np.array([c for _, _, c in STATED]),
    )


#: Groups of features, and when each may be named as a reason.
REASONS = {
    "relevance": (("category_coverage",), "true"),
    "experience": (("log_participations", "win_rate"), "log_participations > 0"),
    "category": (("log_category_participations", "category_win_rate"), "log_category_participations > 0"),
    "customer": (("log_customer_participations", "customer_win_rate"), "log_customer_participations > 0"),
    "price": (("price_log_distance", "log_start_price"), "log_start_price > 0"),
    "recency": (("days_since_last", "has_history"), "has_history > 0"),
}


def _rows(spark, d):
    return archive.ranker_rows(spark, d)


def tree_rank(spark, d):
    """Every candidate of every purchase by the stated model: its score, and its rank among the purchase's candidates."""
    scored = trees.score(_rows(spark, d), stated_model()).withColumn("score", F.round("tree_score", 6))
    ranked = retrieval.ranked(scored, [F.desc("score"), F.asc(F.col("supplier_inn").cast("string"))], ["lot_id"], most=200)
    return ranked.select("lot_id", "supplier_inn", "score", F.col("rank").cast("long").alias("rank"))


def tree_reasons(spark, d):
    """Why: each candidate's Shapley values in sum, and the three groups of features that lift it most."""
    model = stated_model()
    scored = trees.score(_rows(spark, d), model, shares="shares")
    scored = scored.withColumn("shares", F.transform("shares", lambda x: F.round(x, 9)))
    why = trees.reasons("shares", FEATURES, REASONS)
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    return scored.select("lot_id", "supplier_inn", F.array_join(why, ",").alias("reasons"), F.round(F.lit(model.bias()) + total, 6).alias("score"), F.round(F.get("shares", F.lit(FEATURES.index("win_rate"))), 6).alias("win_rate_share"))


def trained_ranker(spark, d):
    """A model trained on three quarters of the purchases (a purchase's id decides), and the rank it gives to every candidate of the others."""
    rows, scratch = _rows(spark, d), Scratch(spark, "tree-ranker")
    rows = scratch.write("rows", rows)
    aside = F.pmod(F.xxhash64("lot_id"), F.lit(4)) == 0
    model = trees.train(rows.filter(~aside), "lot_id", "label", FEATURES, scratch.write, trees=12, depth=3, rate=0.1, bins=32)
    scored = trees.score(rows.filter(aside), model).withColumn("score", F.round("tree_score", 9))
    ranked = retrieval.ranked(scored, [F.desc("score"), F.asc(F.col("supplier_inn").cast("string"))], ["lot_id"], most=200)
    return ranked.select("lot_id", "supplier_inn", "label", "score", "rank")


QUERIES = {f.__name__: f for f in (tree_rank, tree_reasons, trained_ranker)}

_MODEL = (
    f"rr AS ({{rows}}), "
    "sp(t, k, feature, border) AS (VALUES " + ", ".join(f"({t}, {k}, '{f}', {b}::DOUBLE)" for t, (s, _, _) in enumerate(STATED) for k, (f, b) in enumerate(s)) + "), "
    "lf(t, leaf, value, cover) AS (VALUES " + ", ".join(f"({t}, {i}, {v}::DOUBLE, {c})" for t, (_, vs, cs) in enumerate(STATED) for i, (v, c) in enumerate(zip(vs, cs, strict=True))) + "), "
    "ft AS (UNPIVOT (SELECT lot_id, supplier_inn, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES) + " FROM rr) ON " + ", ".join(FEATURES) + " INTO NAME feature VALUE x), "
    "lv AS (SELECT lot_id, supplier_inn, t, sum(CASE WHEN x > border THEN 1 << k ELSE 0 END) AS leaf FROM ft JOIN sp USING (feature) GROUP BY ALL)"
).format(rows=archive.SQL["ranker_rows"])
_SHARES = """,
pw AS (SELECT a.t, a.leaf, k, sum(CASE WHEN b.leaf % (2 << k) = a.leaf % (2 << k) THEN b.cover ELSE 0 END)::DOUBLE / sum(CASE WHEN b.leaf % (1 << k) = a.leaf % (1 << k) THEN b.cover ELSE 0 END) AS way
  FROM lf a JOIN lf b ON a.t = b.t, (SELECT unnest(range(3)) AS k) GROUP BY ALL),
vs AS (SELECT l.t, b.b, s.s, l.leaf, any_value(l.value) * product(CASE WHEN (s.s >> k) % 2 = 0 THEN way WHEN (l.leaf >> k) % 2 = (b.b >> k) % 2 THEN 1 ELSE 0 END) AS v
  FROM lf l JOIN pw USING (t, leaf), (SELECT unnest(range(8)) AS b) b, (SELECT unnest(range(8)) AS s) s GROUP BY ALL),
va AS (SELECT t, b, s, sum(v) AS v FROM vs GROUP BY ALL),
ph AS (SELECT x.t, x.b AS leaf, sp.feature, sum((y.v - x.v) * CASE bit_count(x.s) WHEN 1 THEN 1.0::DOUBLE / 6 ELSE 1.0::DOUBLE / 3 END) AS share
  FROM va x JOIN va y ON x.t = y.t AND x.b = y.b JOIN sp ON sp.t = x.t AND (x.s >> sp.k) % 2 = 0 AND y.s = x.s + (1 << sp.k) GROUP BY ALL),
sh AS (SELECT lot_id, supplier_inn, feature, round(sum(share), 9) AS share FROM lv JOIN ph USING (t, leaf) GROUP BY ALL),
gs(place, grp, feature, needs) AS (VALUES (0, 'relevance', 'category_coverage', ''), (1, 'experience', 'log_participations', 'log_participations'), (1, 'experience', 'win_rate', 'log_participations'),
  (2, 'category', 'log_category_participations', 'log_category_participations'), (2, 'category', 'category_win_rate', 'log_category_participations'),
  (3, 'customer', 'log_customer_participations', 'log_customer_participations'), (3, 'customer', 'customer_win_rate', 'log_customer_participations'),
  (4, 'price', 'price_log_distance', 'log_start_price'), (4, 'price', 'log_start_price', 'log_start_price'), (5, 'recency', 'days_since_last', 'has_history'), (5, 'recency', 'has_history', 'has_history')),
gr AS (SELECT sh.lot_id, sh.supplier_inn, place, grp, sum(share) AS lift FROM sh JOIN gs USING (feature) LEFT JOIN ft ON (ft.lot_id, ft.supplier_inn, ft.feature) = (sh.lot_id, sh.supplier_inn, gs.needs)
  WHERE needs = '' OR x > 0 GROUP BY ALL),
wh AS (SELECT lot_id, supplier_inn, array_to_string(list(grp ORDER BY lift DESC, place)[:3], ',') AS reasons FROM gr WHERE lift > 1e-6 GROUP BY ALL)"""

SQL = {
    "tree_rank": f"WITH {_MODEL}, sc AS (SELECT lot_id, supplier_inn, round(sum(value), 6) AS score FROM lv JOIN lf USING (t, leaf) GROUP BY ALL) "
    "SELECT lot_id, supplier_inn, score, row_number() OVER (PARTITION BY lot_id ORDER BY score DESC, CAST(supplier_inn AS VARCHAR)) AS rank FROM sc QUALIFY rank <= 200",
    "tree_reasons": f"WITH {_MODEL}, sc AS (SELECT lot_id, supplier_inn, round(sum(value), 6) AS score FROM lv JOIN lf USING (t, leaf) GROUP BY ALL){_SHARES} "
    "SELECT lot_id, supplier_inn, coalesce(reasons, '') AS reasons, score, round(coalesce(share, 0), 6) AS win_rate_share FROM sc LEFT JOIN wh USING (lot_id, supplier_inn) LEFT JOIN sh ON (sh.lot_id, sh.supplier_inn) = (sc.lot_id, sc.supplier_inn) AND sh.feature = 'win_rate'",
}
