"""Lexical, historical and vector retrieval, and the fusion of their rankings.

Texts are matched through posting tables and equi-joins; query terms are the small side and are broadcast only
below a checked number of rows. Rankings end with the id as text, so that ties are settled alike everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions.text import long_tokens, tokens
from tenderloom.operators.scratch import Scratch
from tenderloom.operators.state import first_of_each, spread

K1, B = 1.2, 0.75
RRF_K = 60
#: Query terms up to this many are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000


def small(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def match_flags(docs: DataFrame, text: str, terms: Sequence[str], shortest: int = 3, longest: int = 6) -> DataFrame:
    """``flags``, ``hits``: which of the query's prefixes (of ``shortest`` to ``longest`` characters) a row's tokens start with."""
    one = lambda found, t: F.exists(found, lambda x: x.startswith(t)) if shortest <= len(t) <= longest else F.lit(False)
    # The tokens are bound to a name: a filter on ``hits`` that Spark moves up splits a text once, not once a term.
    flags = F.transform(F.array(tokens(F.col(text))), lambda found: F.array(*[one(found, t) for t in terms]))[0]
    return docs.withColumn("flags", flags).withColumn("hits", F.size(F.filter("flags", lambda f: f)))


def pool(docs: DataFrame, order: Sequence[Column], most: int | None = 500) -> DataFrame:
    """Matching rows, most hits first; with ``most`` None every one. Those without a hit come last, so that they are dropped after the cut."""
    if most is None:
        return docs.filter("hits > 0")
    return docs.orderBy(F.desc("hits"), *order).limit(most).filter("hits > 0")


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, term): a row for each token of each text; length is the text's token count.

    A plain ``explode`` would let Spark move a filter on the tokens up, and split every text once more.
    """
    rows = docs.select(key, long_tokens(F.col(text)).alias("t")).withColumn("length", F.size("t"))
    return rows.select(key, "length", F.explode_outer("t").alias("term")).filter("term is not null")


def postings(docs: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, length): occurrences of each token in each text; length is the text's token count.

    With ``asked`` (term) only those tokens are counted and shuffled.
    """
    rows = occurrences(docs, key, text)
    if asked is not None:
        rows = rows.join(asked, "term", "left_semi")
    return rows.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, score) over the whole corpus; ``queries`` has distinct (query_id, term).

    Corpus figures come from one pass over the texts, document frequencies only for terms asked for.
    """
    docs = spread(docs.select(key, text))
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size(long_tokens(F.col(text)))).alias("mean")).first()
    n, mean = size["n"], size["mean"] or 1.0
    hits = postings(docs, key, text, small(queries.select("term").distinct()))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = hits.join(frequency, "term").withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean))))
    return weighted.join(small(queries), "term").groupBy("query_id", key).agg(F.sum("w").alias("score"))


def bm25_pool(pooled: DataFrame, key: str, terms: int, length: str = "length") -> DataFrame:
    """(key, score) on presence flags, all figures taken over the pool; a text is as long as its matches at least."""
    long = F.greatest(F.col(length), F.col("hits"))
    counts = pooled.agg(F.count("*").alias("n"), F.avg(long).alias("mean"), *[F.count_if(F.col("flags")[i]).alias(f"d{i}") for i in range(terms)]).first()
    n, mean = counts["n"], counts["mean"] or 1.0
    norm = K1 * (1 - B + B * long / F.lit(mean))
    score = F.lit(0.0)
    for i in range(terms):
        idf = float(np.log1p((n - counts[f"d{i}"] + 0.5) / (counts[f"d{i}"] + 0.5)))
        score = score + F.when(F.col("flags")[i], F.lit(idf) * (K1 + 1) / (F.lit(1.0) + norm)).otherwise(0.0)
    return pooled.withColumn("score", score)


def least_common(frequency: DataFrame, most: int = BROADCAST_TERMS) -> float:
    """A document frequency that at most ``most`` terms reach, from the terms counted in a few dozen sizes."""
    sizes = frequency.groupBy(F.floor(F.log2("df") * 4).alias("size")).agg(F.count("*").alias("terms")).collect()
    least, left = float("inf"), most
    for r in sorted(sizes, reverse=True):
        left -= r["terms"]
        if left < 0:
            break
        least = r["size"]
    return least


def tfidf(docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, score): cosine of sublinear TF-IDF vectors of texts and queries.

    Every text is split once, its tokens are dealt by key and counted where they are, and its postings are written. Weights of the commonest terms, which hold most postings, are
    broadcast; only postings of the others are dealt by term.
    """
    scratch = Scratch(docs.sparkSession, "tfidf")
    split = spread(docs.select(key, text)).select(key, long_tokens(F.col(text)).alias("t")).repartition(key)
    p = scratch.write("postings", split.select(key, F.explode_outer("t").alias("term")).filter("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf")))
    n = docs.count()
    df = scratch.write("terms", p.groupBy("term").agg(F.count("*").alias("df")))
    common = F.floor(F.log2("df") * 4) >= least_common(df)
    idf = (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")
    often, seldom = F.broadcast(df.filter(common).select("term", idf)), df.filter(~common).select("term", idf)
    square = F.pow((1 + F.log("tf")) * F.col("idf"), 2).alias("square")
    squares = p.join(often, "term").select(key, square).unionByName(p.join(often, "term", "left_anti").join(seldom, "term").select(key, square))
    norms = squares.groupBy(key).agg(F.sqrt(F.sum("square")).alias("norm"))
    q = small(queries.join(df, "term").select("query_id", "term", idf.alias("qw")))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = p.join(q, "term").groupBy("query_id", key).agg(F.sum((1 + F.log("tf")) * F.col("qw") * F.col("qw")).alias("dot"))
    return dots.join(norms, key).join(small(qn), "query_id").select("query_id", key, (F.col("dot") / F.col("norm") / F.col("qnorm")).alias("score"))


def lexical_channel(scored: DataFrame, title_stems: Column, query_stems: Column) -> DataFrame:
    """(supplier_id, item_id, relevance, inferred): the best offer whose title shares a whole stem with the query."""
    shares = F.arrays_overlap(title_stems, query_stems)
    same = F.array_sort(F.array_distinct(title_stems)) == F.array_sort(F.array_distinct(query_stems))
    rows = scored.withColumns({"_shares": shares, "inferred": ~same}).filter("score > 0 and _shares and supplier_id is not null")
    return rows.groupBy("supplier_id", "item_id").agg(F.max("score").alias("relevance"), F.max_by("inferred", "score").alias("inferred"))


def history_channel(scored: DataFrame, terms: int, share: float = 0.5, win_weight: float = 2.0) -> DataFrame:
    """(supplier_id, relevance): summed scores of lots that match enough of the query, won lots counting double.

    ``scored`` has hits, score, participants and winners (arrays of ids).
    """
    enough = scored.filter((F.col("hits") / F.lit(terms) >= share) & (F.col("score") > 0))
    rows = enough.select("score", "winners", F.explode("participants").alias("supplier_id"))
    weight = F.when(F.array_contains("winners", F.col("supplier_id")), win_weight).otherwise(1.0)
    return rows.groupBy("supplier_id").agg(F.sum(F.col("score") * weight).alias("relevance"))


def tally(hits: DataFrame, refs: int = 5, depth: int = 300) -> DataFrame:
    """(supplier_id, total, rank, items): summed relevance, rank by (-total, id), best references of each item."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("ref_id").cast("string").alias("ref")))), 1, refs)
    items = hits.groupBy("supplier_id", "item_id").agg(F.max("score").alias("relevance"), F.transform(best, lambda x: x["ref"]).alias("refs"))
    totals = items.groupBy("supplier_id").agg(F.sum("relevance").alias("total"), F.sort_array(F.collect_list(F.struct("item_id", "relevance", "refs"))).alias("items"))
    return ranked(totals, [F.desc("total"), F.asc(F.col("supplier_id").cast("string"))], most=depth)


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), *, most: int) -> DataFrame:
    """``rank`` 1..``most`` within ``by``. Without ``by`` the rows are cut first, so that one task ranks few."""
    if not by:
        df = df.orderBy(*order).limit(most)
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col("rank") <= most)


def rrf(rankings: DataFrame, key: str, channels: int, k: int = RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of (channel, key, rank[, weight]); the score is a share of the best possible."""
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1.0)
    out = rankings.groupBy(*by, key).agg(
        F.sum(weight / (F.lit(k) + F.col("rank"))).alias("raw"), F.array_sort(F.collect_list(F.struct("channel", "rank"))).alias("channels")
    )
    return out.withColumn("fusion", F.least(F.lit(1.0), F.col("raw") / F.lit(channels / (k + 1))))


def inject_categories(fused: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """Suppliers of requested categories join with score 0; category coverage goes before the score."""
    return fused.join(coverage, key, "full").withColumns({"fusion": F.coalesce("fusion", F.lit(0.0)), "coverage": F.coalesce("coverage", F.lit(0))})


def requested_categories(requested: Sequence[str]) -> list[str]:
    """``NN.NN`` of each code that begins so."""
    return sorted({c[:5] for c in requested if len(c) >= 5 and c[:2].isdigit() and c[2] == "." and c[3:5].isdigit()})


def category_coverage(cards: DataFrame, requested: Sequence[str], key: str = "supplier_id") -> DataFrame:
    """(key, coverage): how many of the requested categories a supplier has cards in."""
    return cards.filter(F.col("category").isin(requested_categories(requested))).groupBy(key).agg(F.count_distinct("category").cast("int").alias("coverage"))


def best_cards(scored: DataFrame, requested: Sequence[str], key: str, most: int = 300) -> DataFrame:
    """The best card of each supplier, cards of requested categories first, then the ``most`` best suppliers."""
    order = [F.desc(F.col("category").isin(list(requested))), F.desc("dense"), F.desc("bm25"), F.asc("position")]
    return ranked(first_of_each(scored, [key], order), [F.desc("dense"), F.asc(F.col(key).cast("string"))], most=most)


def graded_search(options: DataFrame, text: str) -> DataFrame:
    """Options that contain ``text``, graded by where: label start 0, word start 2, inside 4; keyword 1, 3, 5; detail 6, 7."""
    q = text.lower().replace("ё", "е")
    fold = lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")

    def grade(c: Column, start: int, word: int, inside: int) -> Column:
        f = fold(c)
        return F.when(f.startswith(q), start).when(F.instr(F.concat(F.lit(" "), f), f" {q}") > 0, word).when(F.instr(f, q) > 0, inside).otherwise(9)

    best = F.least(grade(F.col("label"), 0, 2, 4), grade(F.col("keyword"), 1, 3, 5), grade(F.col("detail"), 6, 6, 7))
    return first_of_each(options.withColumn("grade", best).filter("grade < 9"), ["value"], [F.asc("grade"), F.asc("ordinal")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def valid_vectors(df: DataFrame, column: str, size: int) -> DataFrame:
    """Vectors of the right length, finite and not all zero."""
    v = F.col(column)
    return df.filter((F.size(v) == size) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
