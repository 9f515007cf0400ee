"""Queries over the catalogue: current state, versions, analytics, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.operators import analytics, state
from tenderloom.plans import mapping as m

MEASURES = lambda: analytics.Measures(m.AS_OF, offer_days=70, registry_days=300)
SINCE = "2024-01-15"


def _base(spark: SparkSession, d: str) -> DataFrame:
    return analytics.base(m.offers(spark, d), m.sources(spark, d), m.suppliers(spark, d))


def current_state_events(spark, d):
    e = m.read(spark, d, "events")
    return state.current(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error").select("user_id", "event_id", "event_type", "value")


def current_offers(spark, d):
    return m.offers(spark, d).select("offer_id", "source_id", F.coalesce("supplier_id", F.lit(-1)).alias("supplier_id"), "okpd2_code", "price", "availability", "last_seen_at")


def latest_published_run(spark, d):
    e = m.read(spark, d, "events").withColumn("run_id", F.col("user_id"))
    published = e.filter("event_type = 'purchase'").select("run_id", F.col("ts").alias("completed_at"))
    return state.latest_run(e, published).select("run_id", "event_id", "event_type")


def _versions(spark, d):
    return m.offer_versions(spark, d).withColumns({"updated_at": F.col("last_seen_at"), "version": F.unix_micros("last_seen_at"), "is_deleted": F.lit(0)})


def withdraw_absent(spark, d):
    now = state.current(_versions(spark, d), ["offer_id"], [F.desc(c) for c in m.VERSION_ORDER], F.lit(False))
    seen = F.lit("2000-06-01").cast("timestamp")
    gone = state.withdraw_absent(now, F.col("source_id") == 3, seen, F.unix_micros(seen))
    return gone.select("offer_id", "availability", "version")


def delete_stale(spark, d):
    now = state.current(_versions(spark, d), ["offer_id"], [F.desc(c) for c in m.VERSION_ORDER], F.lit(False))
    seen = F.lit("1998-06-01").cast("timestamp")
    gone = state.withdraw_absent(now, F.col("source_id") < 5, seen, F.unix_micros(seen), delete=True)
    return gone.groupBy("source_id", "is_deleted").agg(F.count("*").alias("n"), F.max("version").alias("version"))


def first_seen(spark, d):
    return state.first_seen(m.read(spark, d, "events"), ["user_id"], "ts")


def rekey_merge(spark, d):
    o = m.offers(spark, d).select("offer_id", "source_id", "name", "price", F.col("last_seen_at"), F.date_sub("last_seen_at", 30).cast("timestamp").alias("first_seen_at"))
    return state.rekey(o, F.upper("name"), ["source_id"]).select("source_id", "external_id", "offer_id", "name", "price", "first_seen_at", "last_seen_at", "merged")


def package_save(spark, d):
    v = m.offer_versions(spark, d).select("offer_id", "price", "last_seen_at", F.col("last_seen_at").alias("first_seen_at"), F.hash("l_orderkey").alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), "l_quantity")
    cut = F.lit("2001-01-01").cast("timestamp")
    new = v.filter(F.col("last_seen_at") >= cut)
    saved = state.save_package(new.withColumn("ordinal", F.struct("ordinal", "l_quantity", "price")), v.filter(F.col("last_seen_at") < cut), ["offer_id"], F.lit("2001-12-01").cast("timestamp"))
    return saved.select("offer_id", "price", "first_seen_at", "last_seen_at")


def analytics_totals(spark, d):
    return analytics.totals(_base(spark, d), MEASURES())


def analytics_shares(spark, d):
    return analytics.shares(_base(spark, d), MEASURES())


def analytics_breakdowns(spark, d):
    return analytics.breakdowns(_base(spark, d), MEASURES())


def age_buckets(spark, d):
    return _base(spark, d).groupBy("source_type", MEASURES().age_bucket.alias("bucket")).agg(F.count("*").alias("n"))


def analytics_scoped(spark, d):
    return analytics.totals(analytics.scoped(_base(spark, d), source_type="registry", region="ASIA"), MEASURES())


def category_rollup(spark, d):
    return analytics.categories(_base(spark, d), MEASURES())


def source_offers(spark, d):
    return analytics.source_offers(_base(spark, d), MEASURES())


def _runs(spark, d):
    return m.runs(spark, d).join(F.broadcast(m.sources(spark, d).select("source_id")), "source_id")


def source_runs(spark, d):
    return analytics.source_runs(_runs(spark, d), F.lit(SINCE).cast("timestamp"))


def run_totals(spark, d):
    return analytics.run_totals(_runs(spark, d), F.lit(SINCE).cast("timestamp"))


def recent_runs(spark, d):
    return _runs(spark, d).orderBy(F.desc("finished_at"), "run_id").limit(50).select("run_id", "source_id", "status", "finished_at", "offers_extracted")


def source_report(spark, d):
    out = analytics.source_report(m.sources(spark, d), source_offers(spark, d), source_runs(spark, d))
    return out.select("source_id", "source_name", "offers", "companies", "fresh", "runs", "failures", "last_status")


def problem_matrix(spark, d):
    return analytics.problem_matrix(_base(spark, d), MEASURES())


SEVERITY = {"no_supplier": 1, "unverified": 2, "no_category": 2, "no_price": 3, "no_attributes": 3, "stale": 1, "unknown_age": 1}


def attention_top5(spark, d):
    return analytics.attention(problem_matrix(spark, d), SEVERITY)


def record_page(spark, d):
    return analytics.records(_base(spark, d), MEASURES(), "no_price", prefix="2", offset=20, most=20).drop("supplier_id")


def coverage_report(spark, d):
    return analytics.coverage(_base(spark, d), MEASURES())


def keyset_page(spark, d):
    e = m.read(spark, d, "events").select("event_id", "ts", "event_type")
    cursor = F.struct(F.lit("2024-01-20").cast("timestamp_ntz").alias("ts"), F.lit(10**6).cast("long").alias("event_id"))
    return e.filter(F.struct("ts", "event_id") < cursor).orderBy(F.desc("ts"), F.desc("event_id")).limit(21)


def limit_by(spark, d):
    o = _base(spark, d).filter("supplier_id is not null")
    return state.first_of_each(o, ["supplier_id"], [F.desc("price"), F.asc("offer_id")], 3).select("supplier_id", "offer_id", "price")


def union_padded(spark, d):
    """Three tables of different shapes under one another, missing columns null, then one row a lot."""
    orders = m.read(spark, d, "orders").select(F.col("o_orderkey").alias("lot_id"), F.col("o_orderpriority").alias("subject"))
    items = m.product_rows(spark, d).select("lot_id", "product_name", "okpd2_code")
    part = m.participation_rows(spark, d).select("lot_id", "supplier_inn", "is_winner")
    rows = orders.unionByName(items, allowMissingColumns=True).unionByName(part, allowMissingColumns=True)
    texts = rows.groupBy("lot_id").agg(
        F.max("subject").alias("subject"),
        F.sort_array(F.collect_set("product_name")).alias("names"),
        F.sort_array(F.collect_set("supplier_inn")).alias("participants"),
        F.sort_array(F.collect_set(F.when(F.col("is_winner"), F.col("supplier_inn")))).alias("winners"),
    ).filter("size(participants) > 0 and subject is not null")
    strings = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return texts.select("lot_id", "subject", F.array_join(F.slice("names", 1, 100), "; ").alias("names"), strings("participants"), strings("winners"))


def supplier_lots(spark, d):
    """The lots of each supplier: the lot table's participant lists unnested."""
    texts = union_padded(spark, d).select("lot_id", F.split("participants", ",").alias("who"), F.split("winners", ",").alias("won"))
    rows = texts.select("lot_id", F.explode("who").alias("supplier"), "won")
    return rows.select(F.col("supplier").cast("long").alias("supplier_id"), "lot_id", F.array_contains("won", F.col("supplier")).alias("won"))


def identity_unique(spark, d):
    """Tax numbers (here: account balances in hundreds) that belong to one supplier only."""
    c = m.read(spark, d, "customer").select(F.floor(F.col("c_acctbal") / 10).cast("long").alias("inn"), F.col("c_custkey").alias("supplier_id"))
    return c.groupBy("inn").agg(F.min("supplier_id").alias("supplier_id"), F.count_distinct("supplier_id").alias("n")).filter("n = 1").drop("n")


def semi_anti(spark, d):
    """Lines of lots with a conflict-free supplier, and suppliers without lines since a date."""
    line, order = m.read(spark, d, "lineitem"), m.read(spark, d, "orders")
    big = order.filter("o_totalprice > 300000").select("o_orderkey")
    kept = line.join(big, line.l_orderkey == big.o_orderkey, "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n")).select(F.lit("semi").alias("kind"), F.col("l_returnflag").alias("key"), "n")
    idle = order.join(line, line.l_orderkey == order.o_orderkey, "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit("anti").alias("kind"), F.col("o_orderstatus").alias("key"), "n")
    return kept.unionByName(idle)


def latency_percentiles(spark, d):
    e = m.read(spark, d, "events")
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = e.groupBy("event_type").agg(p.alias("p"), F.avg("value").alias("mean"), F.max("value").alias("worst"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select("event_type", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("mean", 6).alias("mean"), "worst", "n", "errors")


def stage_breakdown(spark, d):
    e = m.read(spark, d, "events")
    stage = F.when(F.col("value") < 5, "lexical").when(F.col("value") < 20, "history").otherwise("vector")
    key = F.get_json_object("props", "$.k").cast("double")
    out = e.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.percentile(key, F.lit(0.5)).alias("p50"), F.percentile(key, F.lit(0.95)).alias("p95"), F.max(key).alias("worst"), F.avg(key).alias("mean"))
    return out.select("stage", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "worst", F.round("mean", 6).alias("mean"))


def attribute_json(spark, d):
    e = m.read(spark, d, "events")
    attributes = F.from_json("props", "map<string,string>")
    return e.select("event_type", F.try_element_at(attributes, F.lit("k")).cast("int").alias("k"), F.size(attributes).alias("keys")).groupBy("event_type", "keys").agg(F.sum("k").cast("long").alias("total"), F.count("k").alias("n"))


def list_page(spark, d):
    """An upload list: search, status filter, counts by status, one page of twenty."""
    o = m.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lower("o_orderpriority").alias("title"), "o_orderdate")
    hits = o.filter(F.col("title").contains("high") & (F.col("o_orderstatus") == "F"))
    return hits.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20)


def unique_best(spark, d):
    """In each lot with two suppliers or more the one with the single largest sum above 0, if there is one."""
    from pyspark.sql import Window

    sums = m.read(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("v"))
    w = Window.partitionBy("l_orderkey")
    best = sums.withColumns({"top": F.max("v").over(w), "n": F.count("*").over(w)})
    best = best.withColumn("ties", F.count_if(F.col("v") == F.col("top")).over(w))
    return best.filter("v = top and ties = 1 and n >= 2 and v > 0").select("l_orderkey", "l_suppkey", "v")


def csv_export(spark, d):
    """Formula-safe cells of supplier rows, joined by semicolons."""
    from tenderloom.functions.text import csv_cell

    s = m.read(spark, d, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "=").otherwise(""), F.col("s_name"), F.when(F.col("s_suppkey") % 4 == 0, '; "x"').otherwise(""))
    return s.select("s_suppkey", F.concat_ws(";", csv_cell(F.col("s_suppkey")), csv_cell(name)).alias("line"))


QUERIES = {f.__name__: f for f in (
    current_state_events, current_offers, latest_published_run, withdraw_absent, delete_stale, first_seen, rekey_merge, package_save,
    analytics_totals, analytics_shares, analytics_breakdowns, age_buckets, analytics_scoped, category_rollup, source_offers, source_runs, run_totals,
    recent_runs, source_report, problem_matrix, attention_top5, record_page, coverage_report, keyset_page, limit_by, union_padded, supplier_lots,
    identity_unique, semi_anti, latency_percentiles, stage_breakdown, attribute_json, list_page, unique_best, csv_export,
)}

_B = "WITH" + m.SQL
_NOW = _B + ", now AS (SELECT *, epoch_us(last_seen_at) AS version FROM offer_versions QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY last_seen_at DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) = 1)"
_TOTALS = "count(*) AS offers, count(DISTINCT supplier_id) AS companies, count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT known) AS unknown_age, count(*) FILTER (searchable) AS searchable, count(*) FILTER (commercial) AS commercial, count(*) FILTER (commercial AND price IS NOT NULL) AS priced"
_BUCKET = "CASE WHEN NOT known THEN 'unknown' WHEN age < 86400 THEN 'd1' WHEN age < 604800 THEN 'd7' WHEN age < 2592000 THEN 'd30' ELSE 'older' END"
_ORIGIN = "CASE WHEN is_system THEN 'system' WHEN reported THEN 'source' ELSE 'absent' END"
_CAT = "count(*) AS offers, count(DISTINCT supplier_id) AS companies, count(*) FILTER (verified) AS verified, count(*) FILTER (fresh) AS fresh, count(*) FILTER (price IS NOT NULL) AS priced, count(*) FILTER (searchable) AS searchable, count(*) FILTER (is_system) AS system, count(*) FILTER (reported) AS reported"
_SO = "so AS (SELECT source_id, count(*) AS offers, count(DISTINCT supplier_id) AS companies, count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT known) AS unknown_age, max(last_seen_at) FILTER (known) AS last_seen_at FROM base GROUP BY 1)"
_SR = f"sr AS (SELECT source_id, max(finished_at) FILTER (status = 'success') AS last_success, max(finished_at) AS last_run, arg_max(status, (finished_at, run_id)) AS last_status, count(*) FILTER (finished_at >= TIMESTAMP '{SINCE}') AS runs, count(*) FILTER (finished_at >= TIMESTAMP '{SINCE}' AND status = 'failed') AS failures FROM runs JOIN sources USING (source_id) GROUP BY 1)"
_PM = "pm AS (SELECT source_id, any_value(source_name) AS source_name, count(*) AS offers, count(*) FILTER (supplier_id IS NULL) AS no_supplier, count(*) FILTER (supplier_id IS NOT NULL AND seller_status <> 'verified') AS unverified, count(*) FILTER (okpd2_code = '') AS no_category, count(*) FILTER (commercial AND price IS NULL) AS no_price, count(*) FILTER (NOT has_attributes) AS no_attributes, count(*) FILTER (known AND NOT fresh) AS stale, count(*) FILTER (NOT known) AS unknown_age FROM base GROUP BY 1)"
_LT = """WITH """ + m.ARCHIVE_SQL.split("versions AS (")[0].rstrip().rstrip(",") + """,
lt AS (SELECT o_orderkey AS lot_id, o_orderpriority AS subject,
  (SELECT array_to_string(list_slice(list_sort(list(DISTINCT product_name)), 1, 100), '; ') FROM product_rows p WHERE p.lot_id = o_orderkey) AS names,
  (SELECT array_to_string(list_sort(list(DISTINCT supplier_inn)), ',') FROM participation_rows p WHERE p.lot_id = o_orderkey) AS participants,
  (SELECT array_to_string(list_sort(list(DISTINCT supplier_inn)), ',') FROM participation_rows p WHERE p.lot_id = o_orderkey AND is_winner) AS winners
  FROM orders)"""

SQL = {
    "current_state_events": "SELECT user_id, event_id, event_type, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'",
    "current_offers": _B + " SELECT offer_id, source_id, coalesce(supplier_id, -1) AS supplier_id, okpd2_code, price, availability, last_seen_at FROM offers",
    "latest_published_run": "SELECT user_id AS run_id, event_id, event_type FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, user_id DESC LIMIT 1)",
    "withdraw_absent": _NOW + " SELECT offer_id, 'unavailable' AS availability, greatest(version + 1, epoch_us(TIMESTAMP '2000-06-01')) AS version FROM now WHERE source_id = 3 AND last_seen_at < TIMESTAMP '2000-06-01' AND availability <> 'unavailable'",
    "delete_stale": _NOW + " SELECT source_id, 1 AS is_deleted, count(*) AS n, max(greatest(version + 1, epoch_us(TIMESTAMP '1998-06-01'))) AS version FROM now WHERE source_id < 5 AND last_seen_at < TIMESTAMP '1998-06-01' GROUP BY 1",
    "first_seen": "SELECT user_id, min(ts) AS first_seen_at FROM events GROUP BY 1",
    "rekey_merge": _B + " SELECT source_id, upper(name) AS external_id, max(offer_id) AS offer_id, arg_max(name, offer_id) AS name, arg_max_null(price, offer_id) AS price, CAST(min(last_seen_at - to_days(30)) AS TIMESTAMP) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) AS merged FROM offers GROUP BY 1, 2",
    "package_save": _B + ", late AS (SELECT offer_id, price FROM offer_versions WHERE last_seen_at >= TIMESTAMP '2001-01-01' QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY last_seen_at DESC, l_orderkey * 10 + l_linenumber DESC, l_quantity DESC, price DESC NULLS LAST) = 1), seen AS (SELECT offer_id, min(last_seen_at) AS s FROM offer_versions WHERE last_seen_at < TIMESTAMP '2001-01-01' GROUP BY 1) SELECT offer_id, price, coalesce(least(TIMESTAMP '2001-12-01', s), TIMESTAMP '2001-12-01') AS first_seen_at, TIMESTAMP '2001-12-01' AS last_seen_at FROM late LEFT JOIN seen USING (offer_id)",
    "analytics_totals": _B + f" SELECT {_TOTALS} FROM base",
    "analytics_shares": _B + " SELECT round(count(*) FILTER (fresh) / count(*) FILTER (known), 6) AS fresh_share, round(count(*) FILTER (searchable) / count(*), 6) AS searchable_share, round(count(*) FILTER (commercial AND price IS NOT NULL) / count(*) FILTER (commercial), 6) AS priced_share FROM base",
    "analytics_breakdowns": _B + f" SELECT 'composition' AS dimension, source_type AS key, count(*) AS n FROM base GROUP BY 2 UNION ALL SELECT 'age', {_BUCKET}, count(*) FROM base GROUP BY 2 UNION ALL SELECT 'availability', availability, count(*) FROM base GROUP BY 2 UNION ALL SELECT 'origin', {_ORIGIN}, count(*) FROM base GROUP BY 2",
    "age_buckets": _B + f" SELECT source_type, {_BUCKET} AS bucket, count(*) AS n FROM base GROUP BY 1, 2",
    "analytics_scoped": _B + f" SELECT {_TOTALS} FROM base WHERE source_type = 'registry' AND region = 'ASIA'",
    "category_rollup": _B + f" SELECT 1 AS level, CASE WHEN length(okpd2_code) < 2 THEN '' ELSE left(okpd2_code, 2) END AS code, '' AS parent, {_CAT} FROM base GROUP BY 2 UNION ALL SELECT 2, left(okpd2_code, 5), left(okpd2_code, 2), {_CAT} FROM base WHERE length(okpd2_code) >= 5 GROUP BY 2, 3",
    "source_offers": _B + f", {_SO} SELECT * FROM so",
    "source_runs": _B + f", {m.RUNS_SQL}, {_SR} SELECT * FROM sr",
    "run_totals": _B + f", {m.RUNS_SQL} SELECT count(*) FILTER (status = 'success') AS succeeded, count(*) AS runs, count(*) FILTER (status = 'partial') AS partial FROM runs JOIN sources USING (source_id) WHERE finished_at >= TIMESTAMP '{SINCE}'",
    "recent_runs": _B + f", {m.RUNS_SQL} SELECT run_id, source_id, status, finished_at, offers_extracted FROM runs JOIN sources USING (source_id) ORDER BY finished_at DESC, run_id LIMIT 50",
    "source_report": _B + f", {m.RUNS_SQL}, {_SO}, {_SR} SELECT source_id, source_name, coalesce(offers, 0) AS offers, coalesce(companies, 0) AS companies, coalesce(fresh, 0) AS fresh, coalesce(runs, 0) AS runs, coalesce(failures, 0) AS failures, last_status FROM sources LEFT JOIN so USING (source_id) LEFT JOIN sr USING (source_id)",
    "problem_matrix": _B + f", {_PM} SELECT * FROM pm",
    "attention_top5": _B + f", {_PM}, u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS problem, {s} AS severity, CAST(sum({n}) AS BIGINT) AS n FROM pm" for n, s in SEVERITY.items()) + ") SELECT * FROM u WHERE n > 0 ORDER BY severity, n DESC, problem LIMIT 5",
    "record_page": _B + " SELECT offer_id, source_id, okpd2_code, last_seen_at, count(*) OVER () AS total FROM base WHERE commercial AND price IS NULL AND starts_with(okpd2_code, '2') ORDER BY last_seen_at DESC, offer_id LIMIT 20 OFFSET 20",
    "coverage_report": _B + " SELECT count(*) AS offers, count(supplier_id) AS with_supplier, count(*) FILTER (verified) AS verified, count(*) FILTER (okpd2_code <> '') AS coded, count(price) AS priced, count(*) FILTER (has_attributes) AS described, count(*) FILTER (is_system) AS system, count(*) FILTER (reported) AS reported, count(*) FILTER (searchable) AS searchable, count(*) FILTER (fresh) AS fresh FROM base",
    "keyset_page": "SELECT event_id, ts, event_type FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 1000000) ORDER BY ts DESC, event_id DESC LIMIT 21",
    "limit_by": _B + " SELECT supplier_id, offer_id, price FROM base WHERE supplier_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY price DESC NULLS LAST, offer_id) <= 3",
    "union_padded": _LT + " SELECT lot_id, subject, names, participants, coalesce(winners, '') AS winners FROM lt WHERE participants IS NOT NULL AND subject IS NOT NULL",
    "supplier_lots": _LT + " SELECT DISTINCT supplier_inn AS supplier_id, lot_id, bool_or(coalesce(is_winner, false)) OVER (PARTITION BY lot_id, supplier_inn) AS won FROM participation_rows JOIN (SELECT lot_id FROM lt WHERE participants IS NOT NULL AND subject IS NOT NULL) USING (lot_id)",
    "identity_unique": "SELECT CAST(floor(c_acctbal / 10) AS BIGINT) AS inn, min(c_custkey) AS supplier_id FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1",
    "semi_anti": "SELECT 'semi' AS kind, l_returnflag AS key, count(*) AS n FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) ON l_orderkey = o_orderkey GROUP BY 2 UNION ALL SELECT 'anti', o_orderstatus, count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, max(value) AS worst, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "stage_breakdown": "SELECT CASE WHEN value < 5 THEN 'lexical' WHEN value < 20 THEN 'history' ELSE 'vector' END AS stage, count(*) AS n, round(quantile_cont(k, 0.5), 6) AS p50, round(quantile_cont(k, 0.95), 6) AS p95, max(k) AS worst, round(avg(k), 6) AS mean FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1",
    "attribute_json": "SELECT event_type, CAST(len(json_keys(props)) AS INTEGER) AS keys, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1, 2",
    "list_page": "SELECT o_orderkey, o_orderstatus, lower(o_orderpriority) AS title, o_orderdate FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20",
    "unique_best": "WITH s AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT *, max(v) OVER (PARTITION BY l_orderkey) AS top, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s) SELECT l_orderkey, l_suppkey, v FROM (SELECT *, count(*) FILTER (v = top) OVER (PARTITION BY l_orderkey) AS ties FROM w) WHERE v = top AND ties = 1 AND n >= 2 AND v > 0",
    "csv_export": "SELECT s_suppkey, s_suppkey || ';' || CASE WHEN s_suppkey % 4 = 0 THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE x END AS line FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '''=' ELSE '' END || s_name || CASE WHEN s_suppkey % 4 = 0 THEN '; \"x\"' ELSE '' END AS x FROM supplier)",
}
