"""Queries of the search analyzer, the normaliser, and of queues and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.functions import names, stemming
from tenderloom.functions import text as t
from tenderloom.operators import queues
from tenderloom.operators.state import spread
from tenderloom.plans import mapping as m
from tenderloom.plans import stem_sql
from tenderloom.sources import files

KEYS = {"размер": "size", "вес": "weight"}


def _suffixed(spark, d):
    """Words of all parts, each with an ending of the stemmer in turn."""
    ends = F.array(*[F.lit(e) for e in t.ENDINGS])
    part = m.read(spark, d, "part").select(F.explode(t.tokens(F.col("p_name"))).alias("word"), F.element_at(ends, (F.col("p_partkey") % len(t.ENDINGS) + 1).cast("int")).alias("ending"))
    return part.select(F.concat("word", F.lit("к"), "ending").alias("word")).distinct()


def stemmed_words(spark, d):
    return _suffixed(spark, d).select("word", t.stem(F.col("word")).alias("stem"))


def _all_texts(spark, d):
    """The documents, and the words with endings, each beside words that a search passes over."""
    suffixed = _suffixed(spark, d).select(F.concat(F.lit("для поставка The "), "word").alias("text"))
    return spread(m.read(spark, d, "documents").select("text")).unionByName(suffixed)


def analyzed_terms(spark, d):
    """Search terms of all texts, by stem. Terms are counted first, so that each is stemmed once."""
    terms = _all_texts(spark, d).select(F.explode(t.search_terms(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return terms.groupBy(stemming.stem(F.col("word")).alias("term")).agg(F.sum("n").alias("n"))


def query_prefixes(spark, d):
    """The prefixes under which every distinct word of the documents and every word with an ending is searched."""
    words = _all_texts(spark, d).select(F.explode(t.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.array_join(t.query_prefixes(F.concat("word", F.lit(" и the x"))), ",").alias("prefixes"))


def expanded_names(spark, d):
    words = F.create_map(*[F.lit(x) for pair in {"blue": "azure", "red": "ruby"}.items() for x in pair])
    return m.read(spark, d, "part").select("p_partkey", t.expand(t.drop_phrases(F.col("p_name"), ["new", "old rod"]), words).alias("name"))


def _named_parts(spark, d):
    p = spread(m.read(spark, d, "part"))
    name = F.concat(
        F.initcap("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") ГОСТ 12-"), F.col("p_size").cast("string"), F.lit(" 220 В, "), F.col("p_size").cast("string"), F.lit(",5 мм"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" арт. A-"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(", "), (F.col("p_partkey") + 10000).cast("string"))).otherwise(""),
    )
    brand = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")
    return p.select("p_partkey", names.decompose(name, brand, F.lit("")).alias("parts"))


def name_parts(spark, d):
    out = _named_parts(spark, d)
    return out.select("p_partkey", "parts.core", "parts.brand", "parts.article", F.col("parts.attributes")["gost"].alias("gost"), F.col("parts.attributes")["voltage_v"].alias("volts"), F.col("parts.attributes")["length_mm"].alias("mm"))


def merge_keys(spark, d):
    keyed = _named_parts(spark, d).select(names.merge_key(F.col("parts")).alias("merge_key"))
    return keyed.groupBy("merge_key").agg(F.count("*").alias("n"))


def attributes_merged(spark, d):
    p = spread(m.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    raw = F.create_map(F.lit(" Размер "), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("  mm")), F.lit("size"), F.lit("второй"), F.lit("Цвет"), F.split("p_name", " ")[0], F.lit("вес"), F.lit(" "))
    merged = names.merge_attributes(F.create_map(F.lit("size"), F.lit("1"), F.lit("brand"), F.col("p_brand")), names.canonical_attributes(raw, KEYS))
    return p.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"))


def _documents(spark, d):
    """Current offers with all that a vector's text is made of."""
    o = m.offers(spark, d).join(m.suppliers(spark, d), "supplier_id", "left")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = {
        "name": F.col("name"), "normalized_name": F.lower(F.split("name", " ")[0]), "item_type": F.when(F.col("l_quantity") > 25, "goods").otherwise("other"), "brand": F.col("brand"),
        "article": F.lit(""), "attributes": F.create_map(F.lit("size"), F.col("l_quantity").cast("int").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string")), "unit": F.lit(" шт "),
        "source_category": F.lit(""), "okpd2_code": F.col("okpd2_code"), "rubric_name": F.lit(""), "supplier_name": empty("supplier_name"), "supplier_role": F.when(F.col("has_attributes"), "reseller").otherwise("unknown"),
        "region": empty("region"), "address": empty("region"), "description": F.when(F.col("l_linenumber") > 5, "long story").otherwise(""),
    }
    content = F.sha2(F.concat_ws("|", "name", "brand", "okpd2_code"), 256)
    columns = [v for k, v in field.items() if k != "attributes"]
    return o.select("offer_id", "supplier_id", "name", "availability", "seller_status", content.alias("content_hash"), names.document_text(field).alias("document"), names.document_hash(content, columns, field["attributes"]).alias("document_hash"))


def offer_documents(spark, d):
    return _documents(spark, d).select("offer_id", "document", "document_hash")


def pending_offers(spark, d):
    """Offers whose vector is missing, of another model, or made of an older document."""
    docs = _documents(spark, d)
    stored = docs.filter("offer_id % 3 <> 0").select(
        F.col("offer_id").alias("entity_id"), F.when(F.col("offer_id") % 7 == 0, "other").otherwise("e5").alias("model_key"), F.lit(64).alias("dimensions"),
        F.when(F.col("offer_id") % 5 == 0, "older").otherwise(F.col("document_hash")).alias("document_hash"),
    )
    return queues.pending(docs, stored, "e5", 64).select("offer_id")


def item_suppliers(spark, d):
    docs = _documents(spark, d)
    matches = docs.select(
        (F.col("offer_id") / 100000).cast("long").alias("item_id"), "offer_id", F.when(F.col("offer_id") % 4 == 0, "older").otherwise(F.col("content_hash")).alias("offer_content_hash"),
        ((F.col("offer_id") % 97) / 97.0).alias("confidence"), F.when(F.col("offer_id") % 5 == 0, "rejected").otherwise("accepted").alias("status"),
    )
    known = m.suppliers(spark, d).withColumn("identity_status", F.when(F.col("supplier_id") % 6 == 0, "claimed").otherwise("verified"))
    return queues.accepted_suppliers(matches, docs, known).withColumn("confidence", F.round("confidence", 6))


def capped_participations(spark, d):
    rows = m.participation_rows(spark, d).groupBy(F.col("supplier_inn").alias("supplier_id"), "lot_id").agg(F.coalesce(F.bool_or("is_winner"), F.lit(False)).alias("won"))
    return queues.capped(rows)


def round_robin(spark, d):
    """Up to six products of each brand, one of each size in turn, each name once."""
    p = m.read(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    out = queues.round_robin(p, ["p_brand"], F.col("p_size"), [F.asc("p_partkey")], F.lower(F.trim("p_name")), 6)
    return out.select("p_brand", F.col("place").cast("long").alias("place"), "p_partkey")


def tolerant_dates(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00"))).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 4 == 2, "31.02.1999").otherwise("soon")
    return m.read(spark, d, "orders").select("o_orderkey", t.tolerant_date(raw).cast("string").alias("day"))


def web_urls(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url")).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("://"), F.lit(":"))).otherwise("https://")
    return m.read(spark, d, "pages").select("page_id", t.is_web_url(raw).alias("web"))


def novelty_sheet(spark, d):
    p = m.read(spark, d, "part")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))
    rows = p.select(
        F.col("p_size").alias("query_id"), F.col("p_brand").alias("category"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey") % 9).alias("rank"), pick("fits", "does_not_fit", "insufficient", "after_clarification", "", None).alias("label"),
        pick("recommended", "check", "error: none", "recommended").alias("system_status"), pick("yes", "no", "unknown").alias("link_ok"), pick("yes", "unknown", "yes", "yes", "yes").alias("product_ok"), *[F.lit("yes").alias(c) for c in ("identity_ok", "novelty_ok", "requirements_ok", "role_ok")], pick("ann", "", "bob", None).alias("reviewer"),
    )
    out = queues.novelty(rows)
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def upload_counts(spark, d):
    o = m.read(spark, d, "orders")
    lots = o.select((F.col("o_orderkey") % 50).alias("upload_id"), (F.col("o_orderkey") % 3 > 0).alias("processed"), (F.col("o_custkey") % 7 == 0).alias("failed"), (F.col("o_custkey") % 5).alias("candidates"))
    return queues.upload_counts(lots)


def _sitemap_files(spark, d):
    """Sitemap files made of the pages: a root index, three indexes under it, ten lists of pages under them. Two files cannot be read."""
    page = m.read(spark, d, "pages").select("url", (F.col("page_id") % 10).alias("leaf"))
    wrap = lambda tag, items: F.concat(F.lit(f"<{tag}index>" if tag == "sitemap" else "<urlset>"), items, F.lit(f"</{tag}index>" if tag == "sitemap" else "</urlset>"))
    loc = lambda c, tag: F.concat(F.lit(f"<{tag}><loc> "), c, F.lit(f" </loc></{tag}>"))
    name = lambda kind, n: F.concat(F.lit(f"{kind}-"), n.cast("string"))
    leaves = page.groupBy("leaf").agg(F.array_join(F.sort_array(F.collect_set(loc(F.col("url"), "url"))), "").alias("x"))
    leaves = leaves.select(name("leaf", F.col("leaf")).alias("url"), F.when(F.col("leaf") != 7, wrap("url", F.col("x"))).alias("content"))
    lists = page.select("leaf").distinct().withColumn("mid", F.col("leaf") % 3)
    mids = lists.groupBy("mid").agg(F.array_join(F.sort_array(F.collect_list(loc(name("leaf", F.col("leaf")), "sitemap"))), "").alias("x"))
    mids = mids.select(name("mid", F.col("mid")).alias("url"), F.when(F.col("mid") == 2, F.lit("<html>")).otherwise(wrap("sitemap", F.col("x"))).alias("content"))
    root = lists.select("mid").distinct().agg(F.array_join(F.sort_array(F.collect_list(loc(name("mid", F.col("mid")), "sitemap"))), "").alias("x"))
    return leaves.unionByName(mids).unionByName(root.select(F.lit("root").alias("url"), wrap("sitemap", F.col("x")).alias("content")))


def sitemap_pages(spark, d):
    """The pages that the root sitemap and one list lead to."""
    roots = spark.createDataFrame([("root",), ("leaf-2",)], "root string")
    return files.expand_sitemaps(_sitemap_files(spark, d), roots)


QUERIES = {f.__name__: f for f in (
    sitemap_pages, stemmed_words, analyzed_terms, query_prefixes, expanded_names, name_parts, merge_keys, attributes_merged, offer_documents, pending_offers, item_suppliers,
    capped_participations, round_robin, tolerant_dates, web_urls, novelty_sheet, upload_counts,
)}

_LIST = "[" + ", ".join(f"'{e}'" for e in t.ENDINGS) + "]"
_STEM = "regexp_replace({}, '^(.{{4,}}?)(?:" + "|".join(t.ENDINGS) + ")$', '\\1')"
_WORDS = f"""ws AS (SELECT DISTINCT w || 'к' || {_LIST}[1 + p_partkey % {len(t.ENDINGS)}] AS word
  FROM (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^0-9a-zа-я]+'), lambda x: x <> '')) AS w FROM part))"""
_STOP = "(" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + ")"
_TEXTS = f"""{_WORDS}, tx AS (SELECT text FROM documents UNION ALL SELECT 'для поставка The ' || word FROM ws),
tw AS (SELECT unnest(string_split_regex(replace(lower(text), 'ё', 'е'), '[^0-9a-zа-я]+')) AS w FROM tx)"""
_PARTS = """np AS (SELECT p_partkey, trim(regexp_replace(lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || lower(p_brand) END || ' 220 в ' || p_size || ' 5 мм', '\\s+', ' ', 'g')) AS core,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS brand, CASE p_partkey % 3 WHEN 0 THEN 'A-' || p_partkey WHEN 1 THEN CAST(p_partkey + 10000 AS VARCHAR) ELSE '' END AS article,
  'ГОСТ 12-' || p_size AS gost, '220' AS volts, p_size || '.5' AS mm FROM part)"""
_DOC = "WITH" + m.SQL + """, dc AS (
  SELECT o.offer_id, o.supplier_id, o.name, o.availability, o.seller_status, o.okpd2_code, sha256(concat_ws('|', o.name, o.brand, o.okpd2_code)) AS content_hash, o.brand,
    string_split(o.name, ' ')[1] AS short, CASE WHEN l_quantity > 25 THEN 'goods' ELSE 'other' END AS kind, coalesce(supplier_name, '') AS seller, CASE WHEN has_attributes THEN 'reseller' ELSE 'unknown' END AS role,
    coalesce(region, '') AS place, CASE WHEN l_linenumber > 5 THEN 'long story' ELSE '' END AS story, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS size, CAST(l_linenumber AS VARCHAR) AS line
  FROM offers o LEFT JOIN suppliers USING (supplier_id)),
dd AS (
  SELECT *, concat_ws(chr(10), name, 'Предмет: ' || lower(short), 'Тип: ' || CASE kind WHEN 'goods' THEN 'товар' ELSE kind END, 'Бренд: ' || brand, 'Характеристики: line: ' || line || '; size: ' || size, 'Единица: шт',
      CASE WHEN okpd2_code <> '' THEN 'ОКПД2: ' || okpd2_code END, CASE WHEN seller <> '' THEN 'Поставщик: ' || seller END, CASE WHEN role = 'reseller' THEN 'Роль: перепродавец' END, CASE WHEN place <> '' THEN 'Местоположение: ' || place END, nullif(story, '')) AS document,
    sha256(concat_ws(chr(31), content_hash, name, lower(short), kind, brand, '', ' шт ', '', okpd2_code, '', seller, role, place, place, story, 'line' || chr(29) || line || chr(30) || 'size' || chr(29) || size)) AS document_hash
  FROM dc)"""

SQL = {
    "sitemap_pages": """WITH RECURSIVE pg AS (SELECT url, page_id % 10 AS leaf FROM pages),
e(parent, child) AS (SELECT DISTINCT 'root', 'mid-' || (leaf % 3) FROM pg UNION SELECT 'mid-' || (leaf % 3), 'leaf-' || leaf FROM pg WHERE leaf % 3 <> 2 UNION SELECT 'leaf-' || leaf, url FROM pg WHERE leaf <> 7),
w(root, node) AS (SELECT 'root', 'root' UNION SELECT 'leaf-2', 'leaf-2' UNION SELECT root, child FROM w JOIN e ON node = parent)
SELECT root, node AS location FROM w WHERE node IN (SELECT url FROM pg)""",
    "stemmed_words": f"WITH {_WORDS} SELECT word, {_STEM.format('word')} AS stem FROM ws",
    "analyzed_terms": f"WITH {_TEXTS}, tk AS (SELECT w, count(*) AS n FROM tw WHERE length(w) >= 2 AND w NOT IN {_STOP} GROUP BY 1), {stem_sql.stems('tk')} SELECT stem AS term, CAST(sum(n) AS BIGINT) AS n FROM tk JOIN st USING (w) GROUP BY 1",
    "query_prefixes": f"WITH {_TEXTS}, {stem_sql.stems('tw')}, cp AS (SELECT w, coalesce(max(n), 0) AS n FROM st, (SELECT unnest(range(1, 7)) AS n) WHERE left(w, n) = left(stem, n) GROUP BY w) SELECT w AS word, CASE WHEN length(left(w, n)) >= 3 AND w NOT IN {_STOP} THEN left(w, n) ELSE '' END AS prefixes FROM cp",
    "expanded_names": "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(p_name, '\\bold rod\\b', '', 'g'), '\\bnew\\b', '', 'g'), ' '), lambda x: x <> ''), lambda x: CASE x WHEN 'blue' THEN 'azure' WHEN 'red' THEN 'ruby' ELSE x END), ' ') AS name FROM part",
    "name_parts": f"WITH {_PARTS} SELECT * FROM np",
    "merge_keys": f"WITH {_PARTS} SELECT CASE WHEN brand <> '' AND article <> '' THEN lower(brand || ' ' || article) ELSE core END AS merge_key, count(*) AS n FROM np GROUP BY 1",
    "attributes_merged": "SELECT p_partkey, 'brand=' || p_brand || ';size=' || p_size || ' mm;цвет=' || string_split(p_name, ' ')[1] AS attributes FROM part",
    "offer_documents": _DOC + " SELECT offer_id, document, document_hash FROM dd",
    "pending_offers": _DOC + " SELECT offer_id FROM dd WHERE availability <> 'unavailable' AND (offer_id % 3 = 0 OR offer_id % 7 = 0 OR offer_id % 5 = 0)",
    "item_suppliers": _DOC + " SELECT offer_id // 100000 AS item_id, supplier_id, s.supplier_name, offer_id, round((offer_id % 97) / 97.0::DOUBLE, 6) AS confidence FROM dd JOIN suppliers s USING (supplier_id) WHERE seller_status = 'verified' AND offer_id % 4 <> 0 AND offer_id % 5 <> 0 AND supplier_id % 6 <> 0",
    "capped_participations": "WITH " + m.RAW_SQL + ", w AS (SELECT supplier_inn AS supplier_id, lot_id, coalesce(bool_or(is_winner), false) AS won FROM participation_rows GROUP BY ALL) SELECT * FROM w ORDER BY won DESC, lot_id DESC, supplier_id LIMIT 5000",
    "round_robin": "WITH x AS (SELECT p_brand, p_size, p_partkey, lower(trim(p_name)) AS k, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS depth FROM part), y AS (SELECT p_brand, k, min((depth, p_size, p_partkey)) AS f FROM x GROUP BY ALL) SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY f) AS place, f[3] AS p_partkey FROM y QUALIFY place <= 6",
    "tolerant_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders",
    "web_urls": "SELECT page_id, page_id % 3 = 0 AS web FROM pages",
    "novelty_sheet": """WITH x AS (SELECT p_size AS q, p_brand AS c, p_partkey % 9 > 0 AS r, ['fits', 'does_not_fit', 'insufficient', 'after_clarification', '', NULL][1 + p_partkey % 6] AS l, ['recommended', 'check', 'error: none', 'recommended'][1 + p_partkey % 4] AS s, p_partkey FROM part),
y AS (SELECT * FROM x WHERE r)
SELECT (SELECT count(DISTINCT q) FROM x) AS queries, (SELECT count(DISTINCT c) FROM x) AS categories, count(*) AS candidates, (SELECT count(DISTINCT q) FROM x WHERE s LIKE 'error:%') AS error_queries,
  round(count(DISTINCT q) FILTER (l = 'fits') / (SELECT count(DISTINCT q) FROM x), 6) AS queries_with_suitable_new, """
    + ", ".join(f"round(count(*) FILTER (l = '{x}') / count(*), 6) AS label_{x}" for x in queues.LABELS)
    + """, round(count(*) FILTER (s = 'recommended' AND l IN ('does_not_fit', 'insufficient')) / count(*), 6) AS false_confirmations, round(count(*) FILTER (p_partkey % 3 = 1) / count(*), 6) AS broken_evidence,
  round(count(*) FILTER (p_partkey % 3 = 2 OR p_partkey % 5 = 1) / count(*), 6) AS unknown_fields, round(count(*) FILTER (coalesce(l, '') = '') / count(*), 6) AS unlabelled, 2 AS reviewers FROM y""",
    "upload_counts": "SELECT o_orderkey % 50 AS upload_id, count(*) AS total, count(*) FILTER (p) AS processed, count(*) FILTER (p AND NOT f AND c > 0) AS ready, CAST(0 AS BIGINT) AS needs_check, count(*) FILTER (p AND NOT f AND c = 0) AS no_candidates, count(*) FILTER (p AND f) AS failed FROM (SELECT o_orderkey, o_orderkey % 3 > 0 AS p, o_custkey % 7 = 0 AS f, o_custkey % 5 AS c FROM orders) GROUP BY 1",
}
