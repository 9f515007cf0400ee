"""Procurement history: cleaning, leakage-free statistics, supplier cards, ranker rows, evidence.

Every statistic is cut by one date (``cut``); a target counts only if its whole procedure lies in the window.

What belongs to a lot is gathered once, as its dossier: a row with its notice, bids, wares and categories. Lots hold few of
them, so that what is counted or paired inside a lot needs no join; only figures of suppliers are dealt anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions.numbers import laplace
from tenderloom.functions.text import category_of, collapse
from tenderloom.operators.retrieval import small
from tenderloom.operators.state import first_of_each

#: Cards whose keys are broadcast, at most; more are joined by shuffle.
KEYS = 500_000
NOTICE = ("procedure_id", "publish_date", "start_price", "procedure_name", "subject", "customer_inn")


def clean_notices(raw: DataFrame) -> DataFrame:
    """Typed notices: blanks collapsed, dates and prices tried, prices below 0 dropped, no lot without an id."""
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    price = F.col("start_price").try_cast("double")
    return raw.filter(none("lot_id").isNotNull()).select(
        F.trim("lot_id").alias("lot_id"),
        none("procedure_id").alias("procedure_id"),
        F.col("publish_date").try_cast("date").alias("publish_date"),
        F.when(price >= 0, price).alias("start_price"),
        F.coalesce(collapse(F.col("procedure_name")), F.lit("")).alias("procedure_name"),
        F.coalesce(collapse(F.col("subject")), F.lit("")).alias("subject"),
        none("customer_inn").alias("customer_inn"),
        F.lower(F.trim("is_smp")).isin("true", "1", "t").alias("is_smp"),
        F.coalesce(F.trim("is_eshop_or_aisgz"), F.lit("")).alias("source_system"),
    )


def clean_suppliers(raw: DataFrame) -> DataFrame:
    """Participations with a well-formed tax number."""
    ok = F.trim("supplier_inn").rlike("^([0-9]{10}|[0-9]{12})$") & (F.trim("lot_id") != "")
    return raw.filter(ok).select(F.trim("lot_id").alias("lot_id"), F.trim("supplier_inn").alias("supplier_inn"), F.col("is_winner").try_cast("boolean").alias("is_winner"))


def lots(notices: DataFrame) -> DataFrame:
    """The first version of each lot, its text, and whether versions differ: one aggregation by lot.

    Lots have few versions, so notices are dealt as they are; partly aggregated ones would carry three structs each.
    """
    fields = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in NOTICE])
    rest = [c for c in notices.columns if c not in ("lot_id", "publish_date", "procedure_name", "start_price")]
    version = F.struct("publish_date", "procedure_name", F.col("start_price").isNull().alias("_unpriced"), "start_price", *rest)
    text = F.when(F.col("subject") == F.col("procedure_name"), F.col("procedure_name")).otherwise(F.trim(F.concat_ws(" ", "procedure_name", "subject")))
    one = notices.repartition("lot_id").groupBy("lot_id").agg(F.min(F.when(F.col("publish_date").isNotNull(), version)).alias("first"), (F.min(fields) != F.max(fields)).alias("notice_conflict"))
    return one.filter("first is not null").select("lot_id", "first.*", "notice_conflict").drop("_unpriced").withColumn("query_text", text)


def participations(rows: DataFrame) -> DataFrame:
    """One row a lot and supplier; labels that differ, or are missing, conflict."""
    yes, no = F.coalesce(F.bool_or("is_winner"), F.lit(False)), F.coalesce(F.bool_or(~F.col("is_winner")), F.lit(False))
    return rows.groupBy("lot_id", "supplier_inn").agg(yes.alias("is_winner"), ((yes & no) | (F.count_if(F.col("is_winner").isNull()) > 0)).alias("label_conflict"))


def products(rows: DataFrame) -> DataFrame:
    """Distinct products, dealt by lot: what is counted by lot later stays where it is."""
    return rows.repartition("lot_id").select("lot_id", "product_name", "okpd2_code", category_of(F.col("okpd2_code")).alias("category")).distinct()


def dossiers(lots: DataFrame, participations: DataFrame, products: DataFrame) -> DataFrame:
    """One row a lot: the notice's fields, ``known`` (it has a notice), ``bids``, ``wares`` and their different
    ``categories``, which are ``unknown`` for a known lot without wares."""
    fields = [c for c in lots.columns if c != "lot_id"]
    kinds = {
        "notice": lots.select("lot_id", F.struct(*fields).alias("notice")),
        "bids": participations.select("lot_id", F.struct("supplier_inn", "is_winner", "label_conflict").alias("bids")),
        "wares": products.select("lot_id", F.struct("product_name", "okpd2_code", "category").alias("wares")),
    }
    # One grouping of all pieces: joins of the three would sort and deal whole dossiers again.
    pieces = [df.select("lot_id", *[F.col(k) if k == kind else F.lit(None).cast(other.schema[k].dataType).alias(k) for k, other in kinds.items()]) for kind, df in kinds.items()]
    each = pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).groupBy("lot_id")
    held = each.agg(F.first("notice", ignorenulls=True).alias("notice"), F.collect_list("bids").alias("bids"), F.collect_list("wares").alias("wares"))
    out = held.select("lot_id", "notice.*", F.col("notice").isNotNull().alias("known"), "bids", "wares")
    bare = F.when(F.col("known"), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("categories", F.when(F.size("wares") > 0, F.array_distinct(F.transform("wares", lambda w: w["category"]))).otherwise(bare))


def bids(dossiers: DataFrame) -> DataFrame:
    """The participations of dossiers, or of lots picked from them."""
    return dossiers.select("lot_id", F.inline("bids"))


def wares(dossiers: DataFrame) -> DataFrame:
    return dossiers.select("lot_id", F.inline("wares"))


def lot_categories(dossiers: DataFrame) -> DataFrame:
    """Categories of each lot's products; ``unknown`` for a lot without products."""
    return dossiers.select("lot_id", F.explode("categories").alias("category"))


def lot_info(dossiers: DataFrame) -> DataFrame:
    """Lots that have a notice, with what is counted inside them."""
    count = lambda c: F.size(c).cast("long")
    each = lambda c, f: F.transform(c, lambda x: x[f])
    return dossiers.filter("known").withColumns(
        {
            "product_count": count(F.col("wares")),
            "okpd2_codes": F.sort_array(F.array_distinct(F.filter(each("wares", "okpd2_code"), lambda x: x.isNotNull()))),
            "participant_count": count(F.col("bids")),
            "winner_count": count(F.filter("bids", lambda b: b["is_winner"])),
            "label_conflict": F.exists("bids", lambda b: b["label_conflict"]),
            "known_positive_inns": F.sort_array(each("bids", "supplier_inn")),
            "category_count": count(F.col("categories")),
        }
    ).drop("known", "wares")


def _group() -> Column:
    return F.coalesce(F.col("procedure_id").cast("string"), F.concat(F.lit("lot:"), F.col("lot_id").cast("string")))


def procedure_dates(lots: DataFrame) -> DataFrame:
    return lots.groupBy(_group().alias("procedure_group")).agg(F.min("publish_date").alias("first_date"), F.max("publish_date").alias("last_date"))


def targets(info: DataFrame, dates: DataFrame, start: str, end: str) -> DataFrame:
    """Lots of the window whose whole procedure lies in it and whose versions agree."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = (F.col("publish_date") >= a) & (F.col("publish_date") < b) & ~F.col("notice_conflict")
    whole = dates.filter((F.col("first_date") >= a) & (F.col("last_date") < b)).select("procedure_group")
    return info.filter(inside).withColumn("procedure_group", _group()).join(whole, "procedure_group", "left_semi").drop("procedure_group")


def past(lots: DataFrame, cut: str) -> DataFrame:
    """Lots before ``cut`` whose versions agree."""
    return lots.filter((F.col("publish_date") < F.lit(cut).cast("date")) & ~F.col("notice_conflict"))


def history(info: DataFrame, cut: str) -> DataFrame:
    """Participations before ``cut``, each with its lot's ``categories``; a win counts where the lot has one winner and no conflict."""
    fields = ["lot_id", "publish_date", "start_price", "customer_inn", "query_text", "category_count", "categories", "winner_count"]
    won = (F.col("is_winner") & ~F.col("label_conflict") & (F.col("winner_count") == 1)).cast("int")
    return past(info, cut).select(*fields, F.inline("bids")).withColumn("winner", won).drop("winner_count", "is_winner", "label_conflict")


def supplier_stats(h: DataFrame) -> DataFrame:
    return h.groupBy("supplier_inn").agg(F.count("*").alias("participations"), F.sum("winner").alias("wins"), F.avg(F.log1p("start_price")).alias("mean_log_price"), F.max("publish_date").alias("last_date"))


def customer_stats(h: DataFrame) -> DataFrame:
    return h.filter("customer_inn is not null").groupBy("supplier_inn", "customer_inn").agg(F.count("*").alias("participations"), F.sum("winner").alias("wins"))


def by_category(h: DataFrame) -> DataFrame:
    """(supplier_inn, category, lot_id, publish_date, winner, category_count): a history row once for each category of its lot."""
    return h.select("supplier_inn", F.explode("categories").alias("category"), "lot_id", "publish_date", "winner", "category_count")


def category_stats(pairs: DataFrame) -> DataFrame:
    """Figures of suppliers in categories, of different (supplier, category, lot). A lot of several categories counts as a fraction in each."""
    one = F.lit(1.0) / F.col("category_count")
    return pairs.groupBy("supplier_inn", "category").agg(
        F.count("*").alias("distinct_lots"), F.round(F.sum(one), 6).alias("participations"), F.round(F.sum(F.col("winner") * one), 6).alias("wins"), F.max("publish_date").alias("last_date")
    )


def card_keys(stats: DataFrame, per_supplier: int = 8) -> DataFrame:
    """(supplier_inn, category, participations, card_id): the ``per_supplier`` most active categories, of which cards are made."""
    top = first_of_each(stats.select("supplier_inn", "category", "participations", "last_date"), ["supplier_inn"], [F.desc("participations"), F.desc("last_date"), F.asc("category")], per_supplier)
    return top.select("supplier_inn", "category", "participations", F.concat_ws(":", F.col("supplier_inn").cast("string"), "category").alias("card_id"))


def _names(length: int | None, most: int) -> Column:
    """The first ``most`` names of a dossier's wares in a row's category."""
    mine = F.filter("wares", lambda w: (w["category"] == F.col("category")) & w["product_name"].isNotNull())
    name = lambda w: F.left(w["product_name"], F.lit(length)) if length else w["product_name"]
    return F.slice(F.sort_array(F.array_distinct(F.transform(mine, name))), 1, most)


def cards(pairs: DataFrame, keys: DataFrame, dossiers: DataFrame, examples: int = 5) -> DataFrame:
    """A text for each of ``keys`` from its latest purchases.

    Only the pairs of these keys meet their lots' wares; most categories of a supplier get no card.
    """
    one = ["supplier_inn", "category"]
    held = pairs.select(*one, "lot_id", "publish_date").join(small(keys.select(*one), KEYS), one, "left_semi")
    text = F.concat(F.left("query_text", F.lit(400)), F.lit(" "), F.array_join(_names(200, 5), "; "))
    rows = held.join(dossiers.select("lot_id", "query_text", "wares"), "lot_id").select(*one, "publish_date", text.alias("profile_description"))
    described = rows.repartition(*one).groupBy(*one, "profile_description").agg(F.max("publish_date").alias("last_date"))
    latest = first_of_each(described, one, [F.desc("last_date"), F.asc("profile_description")], examples)
    order = F.array_sort(F.collect_list(F.struct((-F.unix_date("last_date")).alias("age"), "profile_description")))
    texts = latest.groupBy(*one).agg(F.array_join(F.transform(order, lambda x: x["profile_description"]), "\n").alias("profile_text"), F.count("*").alias("example_count"), F.max("last_date").alias("profile_last_date"))
    return texts.join(keys, one)


def relevant_category_stats(targets: DataFrame, stats: DataFrame) -> DataFrame:
    known = F.col("participations").isNotNull() & (F.col("category") != "unknown")
    return (
        targets.select("lot_id", "category_count", "categories", F.inline("bids"))
        .select("lot_id", "category_count", "supplier_inn", F.explode("categories").alias("category"))
        .join(stats.select("supplier_inn", "category", "participations", "wins"), ["supplier_inn", "category"], "left")
        .groupBy("lot_id", "supplier_inn")
        .agg(
            (F.count_if(known) / F.max("category_count")).alias("category_coverage"),
            F.sum(F.coalesce("participations", F.lit(0.0))).alias("category_participations"),
            F.sum(F.coalesce("wins", F.lit(0.0))).alias("category_wins"),
        )
    )


def fair(targets: DataFrame) -> DataFrame:
    """Lots with rivals, one winner and clear labels."""
    return targets.filter("participant_count > 1 and winner_count = 1 and not label_conflict")


def ranker_rows(targets: DataFrame, suppliers: DataFrame, customers: DataFrame, relevant: DataFrame) -> DataFrame:
    """Twelve features of every participant of lots with rivals, one winner and clear labels."""
    bid = fair(targets).select("lot_id", "start_price", "customer_inn", "publish_date", "product_count", F.inline("bids"))
    s = suppliers.select("supplier_inn", F.col("participations").alias("sp"), F.col("wins").alias("sw"), "mean_log_price", "last_date")
    c = customers.select("supplier_inn", "customer_inn", F.col("participations").alias("cp"), F.col("wins").alias("cw"))
    rows = bid.drop("label_conflict").join(s, "supplier_inn", "left").join(c, ["supplier_inn", "customer_inn"], "left").join(relevant, ["lot_id", "supplier_inn"], "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.select(
        "lot_id",
        "supplier_inn",
        F.col("is_winner").cast("int").alias("label"),
        F.col("sp").isNotNull().cast("int").alias("has_history"),
        F.log1p(zero("sp")).alias("log_participations"),
        laplace(zero("sw"), zero("sp")).alias("win_rate"),
        F.log1p(zero("cp")).alias("log_customer_participations"),
        laplace(zero("cw"), zero("cp")).alias("customer_win_rate"),
        zero("category_coverage").alias("category_coverage"),
        F.log1p(zero("category_participations")).alias("log_category_participations"),
        laplace(zero("category_wins"), zero("category_participations")).alias("category_win_rate"),
        F.coalesce(F.abs(F.log1p("start_price") - F.col("mean_log_price")), F.lit(0.0)).alias("price_log_distance"),
        F.coalesce(F.datediff("publish_date", "last_date"), F.lit(3650)).alias("days_since_last"),
        F.log1p(zero("start_price")).alias("log_start_price"),
        F.log1p("product_count").alias("log_product_count"),
    )


def query_positives(targets: DataFrame) -> DataFrame:
    """Distinct (query_text, supplier_inn): who took part in a lot of that text. One text may have met any number of suppliers."""
    return targets.select("query_text", F.inline("bids")).select("query_text", "supplier_inn").distinct()


def encoder_pairs(targets: DataFrame, cards: DataFrame, cap: int | None = None, seed: int = 42) -> DataFrame:
    """The best card (supplier_inn, category, card_id, participations) of each participant of single-product lots; with
    ``cap``, a seeded draw of that many a supplier.

    Positives of a text are looked up in ``query_positives``, texts of cards by their ids; neither is carried along with every pair.
    """
    lots = targets.filter((F.col("product_count") == 1) & (F.length("query_text") > 0)).withColumn("sample_weight", F.lit(1.0) / F.col("participant_count"))
    each = lots.select("lot_id", "query_text", "sample_weight", "categories", F.inline("bids")).select("lot_id", "query_text", "sample_weight", "supplier_inn", F.explode("categories").alias("category"))
    rows = each.join(cards.select("supplier_inn", "category", "card_id", "participations"), ["supplier_inn", "category"])
    best = first_of_each(rows, ["lot_id", "supplier_inn"], [F.desc("participations"), F.asc("card_id")])
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("lot_id").cast("string")).cast("binary"))
    return best if cap is None else first_of_each(best, ["supplier_inn"], [drawn, F.asc("lot_id")], cap)


def evidence(pairs: DataFrame, keys: DataFrame, dossiers: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` purchases behind each card of ``keys``, wins and latest first, with totals over all of them."""
    one = ["supplier_inn", "category"]
    held = pairs.select(*one, "lot_id", "winner", "publish_date").join(small(keys.select(*one), KEYS), one, "left_semi").repartition(*one)
    whole = Window.partitionBy(*one)
    counted = held.withColumns({"participation_count": F.count("*").over(whole), "win_count": F.sum("winner").over(whole)})
    top = first_of_each(counted, one, [F.desc("winner"), F.desc("publish_date"), F.asc("lot_id")], most)
    return top.join(dossiers.select("lot_id", "wares"), "lot_id").select("lot_id", "category", "supplier_inn", "winner", "publish_date", "participation_count", "win_count", _names(None, 10).alias("product_names"))


def quality_report(raw: dict[str, DataFrame], lots: DataFrame, participations: DataFrame, products: DataFrame, info: DataFrame) -> DataFrame:
    """(counter, value) of a prepared archive, one row a counter."""
    ids = lots.select("lot_id")
    one = lambda name, df: df.agg(F.lit(name).alias("counter"), F.count("*").alias("value"))
    parts: Sequence[DataFrame] = [
        *[one(f"raw_{k}", v) for k, v in sorted(raw.items())],
        one("lots", lots),
        one("participations", participations),
        one("products", products),
        one("suppliers", participations.select("supplier_inn").distinct()),
        one("notice_conflict_lots", lots.filter("notice_conflict")),
        one("supplier_label_conflicts", participations.filter("label_conflict")),
        one("orphan_participations", participations.join(ids, "lot_id", "left_anti")),
        one("orphan_products", products.join(ids, "lot_id", "left_anti")),
    ]
    flags = {"single_product_lots": "product_count = 1", "lots_without_products": "product_count = 0", "lots_without_winner": "winner_count = 0", "lots_with_multiple_winners": "winner_count > 1"}
    counts = info.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in flags.items()])
    stacked = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("value")) for n in flags])).alias("x")).select("x.counter", "x.value")
    out = stacked
    for p in parts:
        out = out.unionByName(p)
    return out
