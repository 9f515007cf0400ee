"""Queries of ranking, policy, classification, evaluation, text functions and data quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tenderloom.functions import identity, numbers
from tenderloom.functions import text as t
from tenderloom.operators import classify, evaluate, history, quality, ranking, vectors
from tenderloom.operators.state import first_of_each
from tenderloom.plans import mapping as m
from tenderloom.plans.archive import Archive

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


# Candidates


def _cards(spark, d):
    """Offers as cards of three items."""
    o = m.offers(spark, d).filter("supplier_id is not null")
    return o.select(
        "supplier_id", "offer_id", "last_seen_at", "price", "seller_status",
        F.concat(F.lit("i"), F.col("offer_id") % 3).alias("item_id"),
        (F.col("last_seen_at") >= F.lit("2000-01-01").cast("timestamp")).alias("current"),
        (F.col("availability") == "available").alias("in_stock"),
        (F.col("seller_status") == "verified").alias("backed"),
        (F.col("classification_method") == "reference").alias("confirmed"),
        F.col("price").isNotNull().alias("evidenced"),
        (F.col("l_quantity") < 10).alias("inferred"),
    )


def match_resolution(spark, d):
    return ranking.resolve_matches(_cards(spark, d)).withColumn("offer_id", F.coalesce("offer_id", F.lit(-1)))


def _candidates(spark, d):
    parts = ranking.component_scores(ranking.resolve_matches(_cards(spark, d)), 3)
    wins = m.participation_rows(spark, d).groupBy(F.col("supplier_inn").alias("supplier_id")).agg((F.count("*") % 9).alias("similar"), (F.count_if("is_winner") % 5).alias("wins"))
    out = parts.join(wins, "supplier_id").join(m.suppliers(spark, d), "supplier_id")
    out = out.withColumns({"fusion": (F.col("supplier_id") % 17) / 17.0, "history": ranking.history_score(F.col("similar"), F.col("wins"))})
    return out.withColumn("total", ranking.with_region_bonus(ranking.total_score(), F.col("region") == "ASIA"))


def component_scores(spark, d):
    return ranking.component_scores(ranking.resolve_matches(_cards(spark, d)), 3).select("supplier_id", F.round("coverage", 6).alias("coverage"), F.round("evidence", 6).alias("evidence"), "only_inferred")


def weighted_score(spark, d):
    return _candidates(spark, d).select("supplier_id", F.round("history", 6).alias("history"), F.round("total", 6).alias("total"))


def _judged(spark, d):
    c = _candidates(spark, d)
    s = F.col("supplier_id")
    return ranking.policy(
        c.withColumns({"has_inn": s % 10 != 0, "conflict": s % 13 == 0, "role": F.when(s % 6 == 0, "unknown").otherwise("reseller"), "role_evidenced": s % 8 != 0, "current_offer": s % 9 != 0, "enrichment_failed": s % 29 == 0})
    )


def policy_status(spark, d):
    return _judged(spark, d).select("supplier_id", F.array_join("reasons", ",").alias("reasons"), "status")


def final_candidates(spark, d):
    j = _judged(spark, d).withColumns({"total": F.round("total", 6), "inn": F.lpad(F.col("supplier_id").cast("string"), 10, "0"), "name": F.col("supplier_name")})
    return ranking.final_order(j, 20).select("supplier_id", "status", "total")


def company_role(spark, d):
    role = F.element_at(F.array(*[F.lit(r) for r in ("manufacturer", "distributor", "reseller", "service", "unknown")]), F.when(F.col("l_quantity") > 49, 1).when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 30, 3).when(F.col("l_quantity") > 20, 4).otherwise(5))
    cards = m.offers(spark, d).filter("supplier_id is not null").select("supplier_id", "offer_id", "last_seen_at", role.alias("role"))
    return ranking.company_role(cards).withColumn("evidence", F.coalesce("evidence", F.lit(-1)))


def candidate_highlights(spark, d):
    c = _candidates(spark, d).withColumns({"stock_items": F.col("supplier_id") % 2, "priced_offers": F.col("supplier_id") % 3, "verified": F.col("supplier_id") % 4 == 0})
    return c.select("supplier_id", F.array_join(ranking.highlights(c), ",").alias("highlights"))


def purchase_summary(spark, d):
    rows = m.participation_rows(spark, d).groupBy(F.col("supplier_inn").alias("supplier_id"), "lot_id").agg(F.coalesce(F.bool_or("is_winner"), F.lit(False)).alias("won"), F.count("*").alias("items"))
    out = ranking.purchase_summary(rows)
    return out.withColumn("records", F.array_join(F.transform("records", lambda x: x.cast("string")), ","))


def archive_evidence(spark, d):
    a = Archive(spark, d)
    lots = a.lots.filter("publish_date < date'1999-01-01'").select("lot_id", F.col("query_text").alias("title"), "publish_date")
    eligible = a.participations.select("supplier_inn", "lot_id", (F.col("is_winner") & ~F.col("label_conflict")).alias("winner")).join(lots, "lot_id")
    items = a.raw_prod.withColumn("okpd2_code", F.coalesce("okpd2_code", F.lit("")))
    out = ranking.archive_evidence(eligible, items, ["22.40.11", "23.55.11"], ["22.40", "24.60"], ["blue", "urgent"])
    return out.select("supplier_inn", "lot_id", "exact_codes", "categories", F.col("text_matches").cast("long").alias("text_matches"), F.col("title_matches").cast("long").alias("title_matches"))


def position_evidence(spark, d):
    positions = spark.createDataFrame([("p1", ["blue", "widget"]), ("p2", ["red"]), ("p3", ["nowhere"]), ("p4", [])], "item_id string, required array<string>")
    lines = m.product_rows(spark, d).join(m.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("lot_id"), F.col("l_suppkey").alias("supplier_id")).distinct(), "lot_id")
    purchases = lines.select("supplier_id", "lot_id", (F.col("lot_id") % 7).alias("priority"), t.tokens(F.col("product_name")).alias("words"))
    return ranking.position_evidence(positions, purchases).select("item_id", "supplier_id", "lot_id")


def feature_matrix(spark, d):
    a = Archive(spark, d)
    keys = a.scratch.write("best_cards", first_of_each(a.card_keys, ["supplier_inn"], [F.desc("participations"), F.asc("card_id")]))
    best = history.cards(a.pairs, keys, a.dossiers).select("supplier_inn", ranking.content_words(F.col("profile_text")).alias("card_words"), "example_count", "profile_last_date")
    s = a.suppliers.select("supplier_inn", "mean_log_price", F.col("participations").alias("supplier_participations"), F.col("wins").alias("supplier_wins"))
    c = a.customers.select("supplier_inn", "customer_inn", F.col("participations").alias("customer_participations"), F.col("wins").alias("customer_wins"))
    n = a.card_keys.groupBy("supplier_inn").agg(F.count("*").alias("card_count"))
    rows = a.targets.select(F.col("lot_id").alias("query_id"), ranking.content_words(F.col("query_text")).alias("query_words"), "start_price", "customer_inn", F.inline("bids")).drop("is_winner", "label_conflict")
    rows = rows.join(s, "supplier_inn", "left").join(c, ["supplier_inn", "customer_inn"], "left").join(best, "supplier_inn", "left").join(n, "supplier_inn", "left")
    none = {x: F.lit(None).cast("double") for x in ("dense_score", "bm25_score", "rrf_score", "dense_rank", "bm25_rank", "category_participations", "category_wins")}
    rows = rows.withColumns({**none, "customer_rank": F.col("supplier_inn") % 40, "card_words": F.coalesce("card_words", F.array().cast("array<string>"))})
    f = ranking.feature_matrix(rows, F.lit(m.CUT).cast("date"))
    f = f.withColumn("price_distance", F.nanvl("price_distance", F.lit(-1.0)))
    return f.select("query_id", "supplier_inn", "dense_rank", "customer_rank", *[F.round(x, 5).alias(x) for x in ("token_coverage", "supplier_win_rate", "category_win_rate", "customer_win_rate", "price_distance")], "profile_age", "missing_customer", "missing_price", "card_count", "profile_examples")


def linear_reasons(spark, d):
    p = m.read(spark, d, "part").withColumns({"a": F.col("p_size") / 50.0, "b": F.col("p_retailprice") / 1000 - 1.5, "c": (F.col("p_partkey") % 3).cast("double")})
    why = ranking.linear_reasons({"a": 0.5, "b": 1.0, "c": -0.25}, {"size": ["a"], "price": ["b"], "other": ["c"], "mixed": ["a", "c"]}, 2)
    return p.select("p_partkey", F.array_join(why, ",").alias("reasons"))


# Classification


def classify_cascade(spark, d):
    p = m.read(spark, d, "part")
    code = lambda n: F.concat(F.lpad((F.col("p_partkey") % n + 10).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("p_size") % 30 + 10).cast("string"), 2, "0"))
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, code(40)).alias("g"), F.when(F.col("p_partkey") % 3 == 0, F.lit("x.1")).alias("r"), F.when(F.col("p_partkey") % 2 == 0, code(60)).alias("a"), F.when(F.col("p_size") > 25, code(80)).alias("l"))
    return classify.cascade(rows, {"gold": "g", "reference": "r", "archive": "a", "lexicon": "l"}).select("p_partkey", "code", "method", "confidence", classify.level(F.col("code")).alias("level"))


def archive_codes(spark, d):
    p = m.read(spark, d, "part").select(F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("code"))
    return classify.unambiguous(p, "name", "code")


def _codes(spark, d):
    return m.offers(spark, d).filter("okpd2_code <> ''").select(F.col("okpd2_code").alias("code")).distinct()


def code_names(spark, d):
    names = m.read(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.lpad("p_size", 2, "0")).otherwise(F.concat(F.lpad("p_size", 2, "0"), F.lit("."), F.lpad((F.col("p_partkey") % 90 + 10).cast("string"), 2, "0"))).alias("code"), "p_name")
    names = names.groupBy("code").agg(F.min("p_name").alias("name"))
    return classify.code_names(_codes(spark, d), names).select("code", F.coalesce("name", F.lit("")).alias("name"))


def source_category_map(spark, d):
    offers = m.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("provider"), F.concat(F.lit(" "), F.upper("p_type")).alias("category"))
    mapping = m.read(spark, d, "part").filter("p_size > 40").groupBy(F.col("p_brand").alias("provider"), F.lower("p_type").alias("category")).agg(F.max("p_size").cast("string").alias("code"))
    return classify.source_categories(offers, mapping).select("p_partkey", F.coalesce("mapped_code", F.lit("")).alias("code"))


def head_phrase(spark, d):
    phrases = spark.createDataFrame([("widget", "1"), ("blue", "2"), ("blue widget", "3"), ("old gear", "4"), ("gear", "5")], "phrase string, code string")
    return classify.head_phrase(m.read(spark, d, "part"), phrases, "p_partkey", "p_name")


def rubric_prefix(spark, d):
    entries = m.read(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.lpad("p_size", 2, "0")).otherwise(F.concat(F.lpad("p_size", 2, "0"), F.lit("."), F.lpad((F.col("p_partkey") % 50 + 10).cast("string"), 2, "0"))).alias("prefix"), "p_brand")
    entries = entries.groupBy("prefix").agg(F.min("p_brand").alias("rubric"))
    return classify.longest_prefix(_codes(spark, d), entries, "code", "prefix", "rubric").withColumn("rubric", F.coalesce("rubric", F.lit("")))


def item_types(spark, d):
    kind = classify.item_type(F.col("okpd2_code"), F.col("name"), {"22": "goods", "43": "work", "49": "service"}, [("new", "goods"), ("new rod", "service"), ("old", "work")])
    return m.offers(spark, d).groupBy(kind.alias("item_type")).agg(F.count("*").alias("n"))


def market_role(spark, d):
    companies = m.read(spark, d, "customer").select(F.col("c_custkey").alias("inn"), F.concat((F.col("c_custkey") % 89 + 10).cast("string"), F.lit("."), (F.col("c_nationkey") + 10).cast("string")).alias("okved"), (F.col("c_custkey") % 7 == 0).cast("int").alias("declared_products"))
    roles = spark.createDataFrame([("1", "service"), ("2", "manufacturer"), ("46", "distributor"), ("4612", "reseller"), ("47", "reseller")], "prefix string, role string")
    return classify.market_role(companies, roles).select("inn", "role")


# Evaluation


def _ranked(spark, d):
    v = m.read(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vectors.nearest(v, q, "vec_id", "embedding", 30).join(q.select("query_id"), "query_id").filter("query_id <> vec_id")
    lists = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("similarity", 9)).alias("s"), F.col("vec_id").cast("string").alias("k"), "vec_id"))), lambda x: x["vec_id"]).alias("candidates"))
    gold = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v.filter("vec_id % 20 <> 0").select("label", "vec_id"), "label").groupBy("query_id", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("participants"))
    return lists.join(gold, "query_id").withColumn("winner", F.element_at("participants", 1 + (F.col("query_id") % F.size("participants")).cast("int")))


def ranking_metrics(spark, d):
    return evaluate.summary(evaluate.query_metrics(_ranked(spark, d), 25))


def metric_slices(spark, d):
    rows = evaluate.query_metrics(_ranked(spark, d), 25).withColumn("slice", F.explode(evaluate.slices(F.repeat(F.lit("w "), (F.col("query_id") % 9 + 1).cast("int")), F.col("label") + 0, F.col("query_id") % 15)))
    return evaluate.summary(rows, [F.col("slice")]).select("slice", "queries", "mrr", "hit_5")


def grouped_metrics(spark, d):
    rows = m.participation_rows(spark, d).groupBy("lot_id", "supplier_inn").agg(F.coalesce(F.bool_or("is_winner"), F.lit(False)).cast("int").alias("label"), F.count("*").alias("score"))
    return evaluate.grouped_metrics(rows.select(F.col("lot_id").alias("group_id"), "score", "label", F.col("supplier_inn").alias("id")))


def paired_bootstrap(spark, d):
    rows = m.read(spark, d, "events").select((F.col("user_id") % 50).alias("cluster"), (F.floor("value") - 20).alias("delta"))
    return evaluate.paired_bootstrap(rows, "cluster", "delta", 2000).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def evaluation_cases(spark, d):
    """Seeded order: the drawn set has no SQL equal, so all cases are taken and compared."""
    a = Archive(spark, d)
    out = evaluate.cases(a.lots, a.participations, "2000-12-31", a.lots.filter("lot_id % 4 = 0"))
    return out.select("lot_id", "winner", F.size("participants").alias("participants"))


def mention_audit(spark, d):
    a = Archive(spark, d)
    rows = a.cards.select("card_id", "profile_text", F.explode(F.array(F.lit("blue widget"), F.lit("old gear"))).alias("product"))
    return rows.select("card_id", "product", evaluate.mention(F.col("profile_text"), F.col("product"), 60).alias("x")).select("card_id", "product", "x.at", "x.kept")


def card_audit(spark, d):
    """Lengths of card texts in words: percentiles, and the share and amount beyond a limit."""
    n = F.size(F.split("profile_text", r"\s+"))
    c = Archive(spark, d).cards.select("example_count", n.alias("n"))
    out = c.groupBy("example_count").agg(F.percentile("n", F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)])).alias("p"), F.max("n").alias("most"), F.avg((F.col("n") > 24).cast("int")).alias("cut"), F.sum(F.greatest(F.col("n") - 24, F.lit(0))).alias("lost"))
    return out.select("example_count", *[F.round(F.col("p")[i], 6).alias(f"p{x}") for i, x in enumerate((50, 90, 95, 99))], "most", F.round("cut", 6).alias("cut"), "lost")


# Text, numbers, identity, quality


def inn_checksum(spark, d):
    digits = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729).cast("string"), 10, "7")
    rows = m.read(spark, d, "orders").select("o_orderkey", digits.alias("raw"))
    return rows.select("o_orderkey", "raw", t.is_inn(F.col("raw")).alias("valid"), F.coalesce(t.inn(F.substring("raw", 2, 9)), F.lit("")).alias("repaired"))


def quantity_parse(spark, d):
    rows = m.read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " шт").when(F.col("p_partkey") % 3 == 1, ",5 кг.").otherwise(" pieces")).alias("x"))
    q = rows.select("p_partkey", t.quantity(F.col("x")).alias("q"))
    return q.select("p_partkey", F.coalesce(F.col("q.value").cast("double"), F.lit(-1.0)).alias("value"), F.coalesce("q.unit", F.lit("")).alias("unit"))


def request_items(spark, d):
    rows = m.read(spark, d, "part").select("p_partkey", F.concat(F.lit("1. "), "p_name", F.lit(" 5 шт, "), "p_brand", F.lit("; доставка завтра; "), F.lower("p_type"), F.lit(" 22.40.11")).alias("x"))
    items = rows.select("p_partkey", F.posexplode(t.interpret(F.col("x"))).alias("pos", "i"))
    return items.select("p_partkey", "pos", "i.name", "i.okpd2")


def masked_messages(spark, d):
    u = m.read(spark, d, "pages").select("page_id", F.concat(F.lit("failed token=abc123  at "), "url", F.lit(" mail a.b@c.org")).alias("x"))
    return u.select("page_id", t.mask_secrets(F.col("x")).alias("message"))


def html_titles(spark, d):
    return m.read(spark, d, "pages").select("page_id", t.title(F.col("html")).alias("title"))


def html_links(spark, d):
    p = m.read(spark, d, "pages").select("page_id", t.links(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").alias("n"), F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")).alias("first"))


def json_ld_blocks(spark, d):
    p = m.read(spark, d, "pages").select("page_id", t.json_ld(F.concat("html", F.when(F.col("page_id") % 2 == 0, '<script type="application/ld+json"> {"@type": "Product"} </script>').otherwise('<script type="application/ld+json">{broken</script>'))).alias("b"))
    return p.select("page_id", F.size("b").alias("blocks"), F.coalesce(F.try_element_at("b", F.lit(-1)), F.lit("")).alias("last"))


def names_as_ids(spark, d):
    return m.read(spark, d, "supplier").select("s_suppkey", identity.name_fingerprint(F.concat("s_name", F.lit("! "))).alias("fingerprint"), identity.external_id(F.lit(""), F.concat(F.lit("http://x/"), F.col("s_suppkey").cast("string")), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))).alias("external_id"))


def uuid_ids(spark, d):
    return m.read(spark, d, "supplier").select("s_suppkey", identity.uuid5(NAMESPACE, F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))).alias("id"))


def content_hashes(spark, d):
    p = m.read(spark, d, "part").withColumns({"name": F.concat(F.lit(" "), F.upper("p_name")), "attributes": F.create_map(F.lit("Size"), F.col("p_size").cast("string"))})
    return p.select(identity.content_hash(["name"], ["p_brand"], "attributes").alias("h")).agg(F.count_distinct("h").alias("contents"))


def unit_prices(spark, d):
    units = spark.createDataFrame([("166", "166", 1.0), ("163", "166", 0.001), ("778", "778", 1.0), ("796", "796", 1.0)], "code string, base string, factor double")
    p = m.read(spark, d, "part").withColumn("code", F.element_at(F.array(*[F.lit(c) for c in ("166", "163", "778", "796")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    p = p.join(F.broadcast(units), "code")
    price, unit = numbers.unit_price(F.col("p_retailprice").cast("decimal(18,4)"), F.col("base"), F.col("code"), F.col("factor").cast("decimal(18,4)"), F.when(F.col("p_size") > 10, F.col("p_size")).cast("decimal(18,4)"))
    return p.select("p_partkey", price.cast("double").alias("price"), unit.alias("unit"))


def validation_counts(spark, d):
    o = m.read(spark, d, "orders")
    rules = {"price": F.col("o_totalprice") < 450000, "status": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp")}
    return quality.issue_counts(quality.validate(o, rules))


def pass_digests(spark, d):
    """Digests of two passes in different orders, which agree, and of other keys, which do not."""
    o = m.read(spark, d, "orders")
    both = quality.table_manifest({"one": (o, "o_orderkey"), "two": (o.repartition("o_custkey"), "o_orderkey"), "other": (o.withColumn("o_orderkey", -F.col("o_orderkey")), "o_orderkey")})
    return both.agg(F.sum("n").alias("n"), F.count_distinct("digest").alias("digests"))


QUERIES = {f.__name__: f for f in (
    match_resolution, component_scores, weighted_score, policy_status, final_candidates, company_role, candidate_highlights, purchase_summary, archive_evidence,
    position_evidence, feature_matrix, linear_reasons, classify_cascade, archive_codes, code_names, source_category_map, head_phrase, rubric_prefix, item_types,
    market_role, ranking_metrics, metric_slices, grouped_metrics, paired_bootstrap, evaluation_cases, mention_audit, card_audit, inn_checksum,
    quantity_parse, request_items, masked_messages, html_titles, html_links, json_ld_blocks, names_as_ids, uuid_ids, content_hashes, unit_prices, validation_counts, pass_digests,
)}

_CARD = "WITH" + m.SQL + """,
cd AS (SELECT supplier_id, offer_id, last_seen_at, 'i' || (offer_id % 3) AS item_id, last_seen_at >= TIMESTAMP '2000-01-01' AS cur, availability = 'available' AS stock, seller_status = 'verified' AS backed,
  classification_method = 'reference' AS conf, price IS NOT NULL AS ev, l_quantity < 10 AS inf FROM offers WHERE supplier_id IS NOT NULL),
gr AS (SELECT *, CASE WHEN cur AND backed AND stock AND ev AND NOT inf THEN 3 WHEN conf AND backed AND ev AND NOT inf THEN 2 WHEN ev THEN 1 ELSE 0 END AS grade FROM cd),
mt AS (SELECT supplier_id, item_id, max(grade) AS grade, arg_max(offer_id, (grade, cur, last_seen_at, CAST(offer_id AS VARCHAR))) AS offer_id FROM gr GROUP BY 1, 2),
ms AS (SELECT supplier_id, item_id, CASE grade WHEN 3 THEN 'stock' WHEN 2 THEN 'catalog' ELSE 'inferred' END AS basis, CASE WHEN grade > 0 THEN offer_id ELSE -1 END AS offer_id FROM mt),
cs AS (SELECT supplier_id, least(1.0, count(DISTINCT item_id) FILTER (basis <> 'inferred') / 3) AS coverage, avg(CASE basis WHEN 'stock' THEN 1.0::DOUBLE WHEN 'catalog' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END) AS evidence, bool_and(basis = 'inferred') AS only_inferred FROM ms GROUP BY 1)"""
_RAW = m.RAW_SQL
# Shares of a Poisson(1) variable that are below 0, 1, ... 7.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
_CAND = _CARD + ", " + _RAW + """,
pw AS (SELECT supplier_inn AS supplier_id, count(*) % 9 AS alike, count(*) FILTER (is_winner) % 5 AS wins FROM participation_rows GROUP BY 1),
cn AS (SELECT *, (supplier_id % 17) / 17.0::DOUBLE AS fusion, (alike / (alike + 5.0::DOUBLE) + wins / (wins + 2.0::DOUBLE)) / 2 AS history FROM cs JOIN pw USING (supplier_id) JOIN suppliers USING (supplier_id)),
c0 AS (SELECT *, 0.4::DOUBLE * fusion + 0.3::DOUBLE * coverage + 0.2::DOUBLE * evidence + 0.1::DOUBLE * history AS t0 FROM cn),
c1 AS (SELECT *, CASE WHEN region = 'ASIA' THEN least(1.0, t0 + 0.05::DOUBLE * (1 - t0)) ELSE t0 END AS total FROM c0),
pj AS (SELECT *, array_to_string(list_filter([CASE WHEN supplier_id % 10 = 0 THEN 'inn_missing' END, CASE WHEN supplier_id % 13 = 0 THEN 'identity_conflict' END,
  CASE WHEN supplier_id % 6 = 0 OR supplier_id % 8 = 0 THEN 'role_unconfirmed' END, CASE WHEN supplier_id % 9 = 0 THEN 'no_current_offer' END,
  CASE WHEN only_inferred OR coverage < 0.5 THEN 'range_unconfirmed' END, CASE WHEN supplier_id % 29 = 0 THEN 'source_unavailable' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c1),
ps AS (SELECT *, CASE WHEN reasons <> '' THEN 'check' ELSE 'recommended' END AS status FROM pj)"""
_A = "WITH" + m.ARCHIVE_SQL
_W = "list_filter(list_distinct(regexp_extract_all(lower({}), '[\\w-]{{3,}}')), lambda x: x NOT IN ('для', 'или', 'год', 'году', 'услуг', 'работ', 'поставка', 'поставку', 'поставки', 'оказание', 'выполнение', 'закупка', 'закупки'))"
_NEAR = "near AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, CAST(e.vec_id AS VARCHAR)) <= 30)"
_EVAL = "WITH " + _NEAR + """, ls AS (SELECT query_id, list(vec_id ORDER BY round(s, 9) DESC, CAST(vec_id AS VARCHAR)) AS candidates FROM near WHERE query_id <> vec_id GROUP BY 1),
gd AS (SELECT q.vec_id AS query_id, q.label, list(e.vec_id ORDER BY e.vec_id) AS participants FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id % 20 <> 0 WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
rw AS (SELECT *, participants[1 + query_id % len(participants)] AS winner, candidates[1:25] AS top FROM ls JOIN gd USING (query_id)),
mx AS (SELECT *, coalesce(list_position(top, winner), 0) AS place, len(list_intersect(top, participants)) / len(participants) AS recall, len(list_intersect(candidates[1:10], participants)) AS ten FROM rw),
my AS (SELECT *, CASE WHEN place > 0 THEN 1.0::DOUBLE / place ELSE 0 END AS mrr, (place BETWEEN 1 AND 5)::DOUBLE AS hit_5 FROM mx)"""
_INN = "(" + " + ".join(f"CAST(substr(raw, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(t.INN_10, 1)) + ") % 11 % 10"

SQL = {
    "match_resolution": _CARD + " SELECT * FROM ms",
    "component_scores": _CARD + " SELECT supplier_id, round(coverage, 6) AS coverage, round(evidence, 6) AS evidence, only_inferred FROM cs",
    "weighted_score": _CAND + " SELECT supplier_id, round(history, 6) AS history, round(total, 6) AS total FROM c1",
    "policy_status": _CAND + " SELECT supplier_id, reasons, status FROM ps",
    "final_candidates": _CAND + " SELECT supplier_id, status, round(total, 6) AS total FROM ps ORDER BY status <> 'recommended', round(total, 6) DESC, lpad(CAST(supplier_id AS VARCHAR), 10, '0'), supplier_name LIMIT 20",
    "company_role": "WITH" + m.SQL + ", rc AS (SELECT supplier_id, offer_id, last_seen_at, CASE WHEN l_quantity > 49 THEN 'manufacturer' WHEN l_quantity > 40 THEN 'distributor' WHEN l_quantity > 30 THEN 'reseller' WHEN l_quantity > 20 THEN 'service' ELSE 'unknown' END AS role FROM offers WHERE supplier_id IS NOT NULL) SELECT supplier_id, CASE WHEN bool_or(role = 'manufacturer') THEN 'manufacturer' WHEN bool_or(role = 'distributor') AND bool_or(role = 'reseller') THEN 'distributor_reseller' WHEN bool_or(role = 'distributor') THEN 'distributor' WHEN bool_or(role = 'reseller') THEN 'reseller' WHEN bool_or(role = 'service') THEN 'service' ELSE 'unknown' END AS role, coalesce(arg_max(offer_id, (last_seen_at, CAST(offer_id AS VARCHAR))) FILTER (role <> 'unknown'), -1) AS evidence FROM rc GROUP BY 1",
    "candidate_highlights": _CAND + " SELECT supplier_id, array_to_string(list_filter([CASE WHEN coverage > 0 THEN 'covers' END, CASE WHEN supplier_id % 2 > 0 THEN 'in_stock' END, CASE WHEN supplier_id % 3 > 0 THEN 'priced' END, CASE WHEN wins > 0 THEN 'wins' END, CASE WHEN alike > 0 THEN 'similar' END, CASE WHEN supplier_id % 4 = 0 THEN 'verified' END], lambda x: x IS NOT NULL), ',') AS highlights FROM c1",
    "purchase_summary": "WITH " + _RAW + ", pr AS (SELECT supplier_inn AS supplier_id, lot_id, coalesce(bool_or(is_winner), false) AS won, count(*) AS items FROM participation_rows GROUP BY 1, 2) SELECT supplier_id, count(*) AS \"similar\", count(*) FILTER (won) AS wins, array_to_string(list_slice(list(lot_id ORDER BY won DESC, items DESC, lot_id), 1, 5), ',') AS records FROM pr GROUP BY 1",
    "archive_evidence": _A + ", el AS (SELECT p.supplier_inn, p.lot_id, p.is_winner AND NOT p.label_conflict AS winner, l.query_text AS title, l.publish_date FROM bid p JOIN deal l USING (lot_id) WHERE l.publish_date < DATE '1999-01-01'), fi AS (SELECT lot_id, count(DISTINCT okpd2_code) FILTER (okpd2_code IN ('22.40.11', '23.55.11')) AS exact_codes, count(DISTINCT left(okpd2_code, 5)) FILTER (left(okpd2_code, 5) IN ('22.40', '24.60')) AS categories, CAST(sum(len(list_intersect(string_split_regex(lower(product_name), '[^0-9a-zа-я]+'), ['blue', 'urgent']))) AS BIGINT) AS text_matches FROM product_rows GROUP BY 1), al AS (SELECT supplier_inn, lot_id, winner, publish_date, coalesce(exact_codes, 0) AS exact_codes, coalesce(categories, 0) AS categories, coalesce(text_matches, 0) AS text_matches, len(list_intersect(string_split_regex(lower(title), '[^0-9a-zа-я]+'), ['blue', 'urgent'])) AS title_matches FROM el LEFT JOIN fi USING (lot_id)) SELECT supplier_inn, lot_id, exact_codes, categories, text_matches, title_matches FROM al WHERE exact_codes > 0 OR categories > 0 OR text_matches > 0 OR title_matches > 0 QUALIFY row_number() OVER (PARTITION BY supplier_inn ORDER BY exact_codes DESC, categories DESC, text_matches DESC, title_matches DESC, publish_date DESC, winner DESC, lot_id) <= 5",
    "position_evidence": "WITH " + _RAW + ", pu AS (SELECT DISTINCT l_suppkey AS supplier_id, lot_id, lot_id % 7 AS priority, string_split_regex(product_name, '[^0-9a-z]+') AS words FROM product_rows JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = lot_id), po(item_id, required) AS (VALUES ('p1', ['blue', 'widget']), ('p2', ['red'])) SELECT item_id, supplier_id, lot_id FROM po JOIN pu ON list_has_all(words, required) QUALIFY row_number() OVER (PARTITION BY item_id, supplier_id ORDER BY priority DESC, lot_id DESC) = 1",
    "feature_matrix": _A + ", bc AS (SELECT * FROM card QUALIFY row_number() OVER (PARTITION BY supplier_inn ORDER BY participations DESC, card_id) = 1), nc AS (SELECT supplier_inn, count(*) AS card_count FROM card GROUP BY 1), r AS (SELECT l.lot_id AS query_id, p.supplier_inn, l.query_text, l.start_price, l.customer_inn, s.mean_log_price, s.participations AS sp, s.wins AS sw, c.participations AS cp, c.wins AS cw, coalesce(bc.profile_text, '') AS profile_text, bc.example_count, bc.profile_last_date, nc.card_count FROM aim l JOIN bid p USING (lot_id) LEFT JOIN seller s ON s.supplier_inn = p.supplier_inn LEFT JOIN pairing c ON c.supplier_inn = p.supplier_inn AND c.customer_inn = l.customer_inn LEFT JOIN bc ON bc.supplier_inn = p.supplier_inn LEFT JOIN nc ON nc.supplier_inn = p.supplier_inn) SELECT query_id, supplier_inn, 301.0::DOUBLE AS dense_rank, CAST(supplier_inn % 40 AS DOUBLE) AS customer_rank, round(len(list_intersect(" + _W.format("query_text") + ", " + _W.format("profile_text") + ")) / greatest(len(" + _W.format("query_text") + "), 1), 5) AS token_coverage, round((coalesce(sw, 0) + 1) / (coalesce(sp, 0) + 2), 5) AS supplier_win_rate, 0.5::DOUBLE AS category_win_rate, round((coalesce(cw, 0) + 1) / (coalesce(cp, 0) + 2), 5) AS customer_win_rate, round(coalesce(abs(ln(1 + start_price) - mean_log_price), -1), 5) AS price_distance, CAST(greatest(coalesce(date_diff('day', profile_last_date, DATE '1999-01-01'), 3650), 0) AS DOUBLE) AS profile_age, (customer_inn IS NULL)::DOUBLE AS missing_customer, (start_price IS NULL)::DOUBLE AS missing_price, CAST(coalesce(card_count, 0) AS DOUBLE) AS card_count, CAST(coalesce(example_count, 0) AS DOUBLE) AS profile_examples FROM r",
    "linear_reasons": "WITH x AS (SELECT p_partkey, 0.5::DOUBLE * (p_size / 50.0::DOUBLE) AS a, p_retailprice / 1000 - 1.5::DOUBLE AS b, -0.25::DOUBLE * (p_partkey % 3) AS c FROM part), g AS (SELECT p_partkey, unnest(['size', 'price', 'other', 'mixed']) AS g, unnest([a, b, c, a + c]) AS v FROM x) SELECT p_partkey, coalesce(array_to_string(list_slice(list(g ORDER BY v DESC, g) FILTER (v > 1e-6), 1, 2), ','), '') AS reasons FROM g GROUP BY 1",
    "classify_cascade": "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 40 + 10 AS VARCHAR) || '.' || (p_size % 30 + 10) END AS g, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 60 + 10 AS VARCHAR) || '.' || (p_size % 30 + 10) END AS a, CASE WHEN p_size > 25 THEN CAST(p_partkey % 80 + 10 AS VARCHAR) || '.' || (p_size % 30 + 10) END AS l FROM part) SELECT p_partkey, coalesce(g, a, l, '') AS code, CASE WHEN g IS NOT NULL THEN 'gold' WHEN a IS NOT NULL THEN 'archive' WHEN l IS NOT NULL THEN 'lexicon' ELSE 'none' END AS method, CASE WHEN g IS NOT NULL THEN 1.0::DOUBLE WHEN a IS NOT NULL THEN 0.8::DOUBLE WHEN l IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CAST(length(replace(coalesce(g, a, l, ''), '.', '')) AS INTEGER) AS level FROM x",
    "archive_codes": "SELECT lower(p_name || ' ' || p_size) AS name, min(p_brand) AS code FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1",
    "code_names": "WITH" + m.SQL + ", cc AS (SELECT DISTINCT okpd2_code AS code FROM offers WHERE okpd2_code <> ''), nn AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 90 + 10 AS VARCHAR), 2, '0') END AS code, min(p_name) AS name FROM part GROUP BY 1) SELECT cc.code, coalesce(a.name, b.name, c.name, '') AS name FROM cc LEFT JOIN nn a ON a.code = cc.code LEFT JOIN nn b ON b.code = left(cc.code, 5) LEFT JOIN nn c ON c.code = left(cc.code, 2)",
    "source_category_map": "WITH mp AS (SELECT p_brand, lower(p_type) AS category, CAST(max(p_size) AS VARCHAR) AS code FROM part WHERE p_size > 40 GROUP BY 1, 2) SELECT p_partkey, coalesce(code, '') AS code FROM part LEFT JOIN mp ON part.p_brand = mp.p_brand AND lower(p_type) = category",
    "head_phrase": "WITH ph(phrase, code) AS (VALUES ('widget', '1'), ('blue', '2'), ('blue widget', '3'), ('old gear', '4'), ('gear', '5')), h AS (SELECT p_partkey, phrase, code, strpos(' ' || p_name || ' ', ' ' || phrase || ' ') AS spot, len(string_split(phrase, ' ')) AS n FROM part, ph) SELECT p_partkey, phrase, code FROM h WHERE spot > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY spot, n DESC, phrase) = 1",
    "rubric_prefix": "WITH" + m.SQL + ", cc AS (SELECT DISTINCT okpd2_code AS code FROM offers WHERE okpd2_code <> ''), en AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 50 + 10 AS VARCHAR), 2, '0') END AS prefix, min(p_brand) AS rubric FROM part GROUP BY 1) SELECT code, coalesce(arg_max(rubric, length(prefix)), '') AS rubric FROM cc LEFT JOIN en ON code = prefix OR starts_with(code, prefix || '.') GROUP BY 1",
    "item_types": "WITH" + m.SQL + " SELECT CASE WHEN left(okpd2_code, 2) = '22' THEN 'goods' WHEN left(okpd2_code, 2) = '43' THEN 'work' WHEN left(okpd2_code, 2) = '49' THEN 'service' WHEN starts_with(name, 'new rod') THEN 'service' WHEN starts_with(name, 'new') THEN 'goods' WHEN starts_with(name, 'old') THEN 'work' ELSE 'unknown' END AS item_type, count(*) AS n FROM offers GROUP BY 1",
    "market_role": "WITH x AS (SELECT c_custkey AS inn, (c_custkey % 89 + 10) || '' || (c_nationkey + 10) AS ok FROM customer), ro(prefix, role) AS (VALUES ('1', 'service'), ('2', 'manufacturer'), ('46', 'distributor'), ('4612', 'reseller'), ('47', 'reseller')), b AS (SELECT inn, arg_max(role, length(prefix)) AS role FROM x JOIN ro ON starts_with(ok, prefix) GROUP BY 1) SELECT x.inn, CASE WHEN x.inn % 7 = 0 THEN 'manufacturer' ELSE coalesce(role, 'unknown') END AS role FROM x LEFT JOIN b USING (inn)",
    "ranking_metrics": _EVAL + " SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg((place > 0)::DOUBLE), 6) AS winner_recall, round(avg(mrr), 6) AS mrr, " + ", ".join(f"round(avg((place BETWEEN 1 AND {n})::DOUBLE), 6) AS hit_{n}" for n in (1, 5, 10, 20)) + ", round(avg((ten > 0)::DOUBLE), 6) AS bidder_hit_10, round(avg(ten / len(participants)), 6) AS participant_recall_10 FROM my",
    "metric_slices": _EVAL + ", sl AS (SELECT *, unnest([CASE WHEN query_id % 9 + 1 <= 4 THEN 'short' ELSE 'long' END, CASE WHEN label > 1 THEN 'multi' ELSE 'single' END, CASE WHEN query_id % 15 = 0 THEN 'no_history' WHEN query_id % 15 < 10 THEN 'small_history' ELSE 'large_history' END]) AS slice FROM my) SELECT slice, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(hit_5), 6) AS hit_5 FROM sl GROUP BY 1",
    "grouped_metrics": "WITH " + _RAW + ", g AS (SELECT lot_id, supplier_inn, coalesce(bool_or(is_winner), false)::INTEGER AS label, count(*) AS score FROM participation_rows GROUP BY 1, 2), o AS (SELECT *, sum(label) OVER (PARTITION BY lot_id) AS w, row_number() OVER (PARTITION BY lot_id ORDER BY score DESC, CAST(supplier_inn AS VARCHAR)) AS place FROM g) SELECT count(*) AS groups, round(avg((place = 1)::DOUBLE), 6) AS accuracy, round(avg(1.0::DOUBLE / place), 6) AS mrr FROM o WHERE w = 1 AND label = 1",
    "evaluation_cases": _A + ", w AS (SELECT lot_id, max(supplier_inn) FILTER (is_winner) AS winner, count(*) FILTER (is_winner) AS n, CAST(count(DISTINCT supplier_inn) AS INTEGER) AS participants FROM bid GROUP BY 1) SELECT lot_id, winner, participants FROM w JOIN deal USING (lot_id) WHERE n = 1 AND publish_date > DATE '2000-12-31' AND lot_id % 4 <> 0",
    "mention_audit": _A + ", x AS (SELECT card_id, unnest(['blue widget', 'old gear']) AS product, profile_text FROM card) SELECT card_id, product, CAST(strpos(lower(profile_text), product) - 1 AS INTEGER) AS \"at\", strpos(lower(profile_text), product) > 0 AND strpos(lower(profile_text), product) - 1 + length(product) <= 60 AS kept FROM x",
    "card_audit": _A + ", x AS (SELECT example_count, len(string_split_regex(profile_text, '\\s+')) AS n FROM card) SELECT example_count, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, CAST(max(n) AS INTEGER) AS most, round(avg((n > 24)::INTEGER), 6) AS cut, CAST(sum(greatest(n - 24, 0)) AS BIGINT) AS lost FROM x GROUP BY 1",
    "inn_checksum": "WITH x AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + o_custkey * 104729 AS VARCHAR), 10, '7') AS raw FROM orders), y AS (SELECT o_orderkey, raw AS r0, '0' || substr(raw, 2, 9) AS raw FROM x) SELECT x.o_orderkey, x.raw, (SELECT " + _INN.replace("raw", "x.raw") + ") = CAST(substr(x.raw, 10, 1) AS INTEGER) AND NOT regexp_full_match(x.raw, '7+') AS valid, CASE WHEN " + _INN.replace("raw", "y.raw") + " = CAST(substr(y.raw, 10, 1) AS INTEGER) AND y.raw <> '0000000000' THEN y.raw ELSE '' END AS repaired FROM x JOIN y USING (o_orderkey)",
    "quantity_parse": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5::DOUBLE ELSE -1.0::DOUBLE END AS value, CASE p_partkey % 3 WHEN 0 THEN 'шт' WHEN 1 THEN 'кг' ELSE '' END AS unit FROM part",
    "request_items": "SELECT p_partkey, pos, upper(left(x, 1)) || substr(x, 2) AS name, okpd2 FROM (SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest([p_name, p_brand, lower(p_type)]) AS x, unnest(['', '', '22.40.11']) AS okpd2 FROM part)",
    "masked_messages": "SELECT page_id, CASE WHEN length(m) <= 240 THEN m ELSE rtrim(left(m, 239)) || '…' END AS message FROM (SELECT page_id, 'failed token=*** at ' || regexp_replace(url, '(https?://[^\\s?#]+)\\?\\S+', '\\1') || ' mail ***' AS m FROM pages)",
    "html_titles": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages",
    "html_links": "SELECT page_id, CAST(len(list_distinct(l)) AS INTEGER) AS n, coalesce(l[1], '') AS first FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=[\"'']([^\"'']+)[\"'']', 1) AS l FROM pages)",
    "json_ld_blocks": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS blocks, CASE WHEN page_id % 2 = 0 THEN '{\"@type\": \"Product\"}' ELSE '' END AS last FROM pages",
    "names_as_ids": "SELECT s_suppkey, left(sha1(trim(regexp_replace(lower(s_name), '[^0-9a-zа-я]+', ' ', 'g'))), 12) AS fingerprint, 'http://x/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '#' || left(sha1(trim(regexp_replace(lower(s_name), '[^0-9a-zа-я]+', ' ', 'g'))), 12) ELSE '' END AS external_id FROM supplier",
    "uuid_ids": f"WITH h AS (SELECT s_suppkey, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode('supplier:' || s_suppkey)) AS h FROM supplier) SELECT s_suppkey, concat_ws('-', left(h, 8), h[9:12], '5' || h[14:16], substr('89ab', CAST((strpos('0123456789abcdef', h[17]) - 1) % 4 + 1 AS INTEGER), 1) || h[18:20], h[21:32]) AS id FROM h",
    "paired_bootstrap": "WITH e AS (SELECT user_id % 50 AS cluster, floor(value) - 20 AS delta FROM events), s AS (SELECT cluster, sum(delta) AS total, count(*) AS n FROM e GROUP BY 1), d AS (SELECT r, total, n, CAST('0x' || left(md5('42:' || r || ':' || cluster), 10) AS UBIGINT) / 1099511627776.0::DOUBLE AS u FROM s, range(2000) t(r)), w AS (SELECT r, total, n, "
    + " + ".join(f"(u >= {b!r}::DOUBLE)::INTEGER" for b in _POISSON)
    + " AS w FROM d), x AS (SELECT sum(w * total) / sum(w * n) AS m FROM w WHERE w > 0 GROUP BY r) SELECT (SELECT round(avg(delta), 6) FROM e) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM x",
    "content_hashes": "SELECT count(DISTINCT (p_name, p_brand, p_size)) AS contents FROM part",
    "unit_prices": "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1000 WHEN 2 THEN CASE WHEN p_size > 10 THEN round_even(p_retailprice / p_size, 4) ELSE p_retailprice END ELSE p_retailprice END AS DOUBLE) AS price, CASE WHEN p_partkey % 4 < 2 THEN '166' WHEN p_partkey % 4 = 2 AND p_size <= 10 THEN '778' ELSE '796' END AS unit FROM part",
    "validation_counts": "SELECT * FROM (SELECT 'price' AS issue, count(*) AS n FROM orders WHERE NOT o_totalprice < 450000 UNION ALL SELECT 'status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'date', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') WHERE n > 0",
    "pass_digests": "SELECT 3 * count(*) AS n, 2 AS digests FROM orders",
}
