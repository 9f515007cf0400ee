"""Work that waits: vectors to be made, uploads in chunks, snapshots that are still fresh; and what is chosen from groups."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted_suppliers(matches: DataFrame, offers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Suppliers of an item: accepted matches made from the offer's present content, of verified sellers and companies."""
    good = matches.filter("status = 'accepted'").select("item_id", "offer_id", F.col("offer_content_hash").alias("content_hash"), "confidence")
    sold = offers.filter("seller_status = 'verified'").select("offer_id", "content_hash", "supplier_id")
    known = suppliers.filter("identity_status = 'verified'").select("supplier_id", "supplier_name")
    return good.join(sold, ["offer_id", "content_hash"]).join(known, "supplier_id").select("item_id", "supplier_id", "supplier_name", "offer_id", "confidence")


def pending(offers: DataFrame, stored: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Offers on sale whose vector under ``model`` is missing or made of another document; by id, a queue takes its batch."""
    mine = stored.filter((F.col("model_key") == model) & (F.col("dimensions") == dimensions)).select(F.col("entity_id").alias("offer_id"), F.col("document_hash").alias("made_of"))
    waiting = offers.filter("availability <> 'unavailable' and content_hash <> '' and name <> ''").join(mine, "offer_id", "left")
    return waiting.filter(F.coalesce("made_of", F.lit("")) != F.col("document_hash")).drop("made_of")


def flush_due(waiting: int, batch: int, oldest: float | None, now: float, interval: float) -> bool:
    """A batch goes when it is full, or when the oldest has waited for ``interval`` seconds."""
    return waiting >= batch or (waiting > 0 and oldest is not None and now - oldest >= interval)


def capped(participations: DataFrame, most: int = 5000) -> DataFrame:
    """Purchases for a summary, won ones and the latest lots first, at most so many."""
    return participations.orderBy(F.desc("won"), F.desc("lot_id"), F.asc("supplier_id")).limit(most)


def round_robin(rows: DataFrame, owner: Sequence[str], group: Column, order: Sequence[Column], key: Column, most: int) -> DataFrame:
    """For each owner up to ``most`` rows, one of each group in turn; what has the same ``key`` is taken once.

    ``place`` numbers them.
    """
    depth = F.row_number().over(Window.partitionBy(*owner, group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*owner, "_key").orderBy("_depth", group))
    place = F.row_number().over(Window.partitionBy(*owner).orderBy("_depth", group))
    numbered = rows.withColumns({"_depth": depth, "_key": key}).filter("_key <> ''").withColumn("_first", first).filter("_first = 1")
    return numbered.withColumn("place", place).filter(F.col("place") <= most).drop("_depth", "_key", "_first")


# What reviewers may say of a candidate, and what they check.
LABELS = ("fits", "after_clarification", "does_not_fit", "insufficient")
CHECKS = ("identity_ok", "novelty_ok", "product_ok", "requirements_ok", "link_ok", "role_ok")


def novelty(rows: DataFrame, labels: Sequence[str] = LABELS, checks: Sequence[str] = CHECKS) -> DataFrame:
    """One row over reviewed candidates (those with a rank): shares of labels, false confirmations, broken links, unknowns."""
    seen = rows.withColumn("reviewed", F.col("rank").isNotNull())
    share = lambda c: F.coalesce(F.avg(F.when(F.col("reviewed"), F.coalesce(c, F.lit(False)).cast("int"))), F.lit(0.0))
    unknown = F.lit(False)
    for c in checks:
        unknown = unknown | F.coalesce(F.col(c) == "unknown", F.lit(False))
    fits = F.count_distinct(F.when(F.col("reviewed") & (F.col("label") == "fits"), F.col("query_id")))
    return seen.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count_distinct("category").alias("categories"),
        F.count_if("reviewed").alias("candidates"),
        F.count_distinct(F.when(F.col("system_status").startswith("error:"), F.col("query_id"))).alias("error_queries"),
        F.coalesce(fits / F.nullif(F.count_distinct("query_id"), F.lit(0)), F.lit(0.0)).alias("queries_with_suitable_new"),
        *[share(F.col("label") == x).alias(f"label_{x}") for x in labels],
        share((F.col("system_status") == "recommended") & F.col("label").isin("does_not_fit", "insufficient")).alias("false_confirmations"),
        share(F.col("link_ok") == "no").alias("broken_evidence"),
        share(unknown).alias("unknown_fields"),
        share(~F.coalesce(F.col("label").isin(*labels), F.lit(False))).alias("unlabelled"),
        F.count_distinct(F.when(F.col("reviewed"), F.nullif(F.col("reviewer"), F.lit("")))).alias("reviewers"),
    )


def upload_counts(lots: DataFrame) -> DataFrame:
    """(upload_id, total, processed, ready, needs_check, no_candidates, failed) of lots (processed, failed, candidates)."""
    done, failed, some = F.col("processed"), F.col("failed"), F.col("candidates") > 0
    return lots.groupBy("upload_id").agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("processed"),
        F.count_if(done & ~failed & some).alias("ready"),
        F.lit(0).cast("long").alias("needs_check"),
        F.count_if(done & ~failed & ~some).alias("no_candidates"),
        F.count_if(done & failed).alias("failed"),
    )


def newest(uploads: DataFrame, most: int = 100) -> DataFrame:
    return uploads.orderBy(F.desc("created_at"), F.desc("upload_id")).limit(most)


def in_chunks(lots: DataFrame, work: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], chunk: int = 16, delays: Sequence[float] = (2.0, 5.0), wait: Callable[[float], None] = time.sleep) -> int:
    """Unfinished lots (lot_id, processed) by chunks: each is worked on, tried again after ``delays``, and saved.

    A chunk that fails every time is saved with ``failed`` set, and the next one is taken. What is saved is not done
    again when the upload is taken up anew. Returns the number of failed chunks.
    """
    left = lots.filter("not processed").withColumn("_chunk", F.floor((F.row_number().over(Window.orderBy("lot_id")) - 1) / chunk))
    failures = 0
    for number in [r["_chunk"] for r in left.select("_chunk").distinct().orderBy("_chunk").collect()]:
        part = left.filter(F.col("_chunk") == number).drop("_chunk")
        for delay in (*delays, None):
            try:
                save(work(part).withColumns({"processed": F.lit(True), "failed": F.lit(False)}))
                break
            except Exception:  # noqa: BLE001  whatever a chunk dies of, the others go on
                if delay is None:
                    save(part.withColumns({"processed": F.lit(True), "failed": F.lit(True)}))
                    failures += 1
                else:
                    wait(delay)
    return failures


def fresh_or(stored: DataFrame, compute: Callable[[], DataFrame], now: Column, seconds: int = 900) -> tuple[DataFrame, list[str]]:
    """The stored snapshot of one scope (as_of, payload) while it is fresh, else a new one; an old one with a warning if that fails."""
    rows = stored.orderBy(F.desc("as_of")).limit(1)
    age = rows.select((now.cast("timestamp").cast("double") - F.col("as_of").cast("timestamp").cast("double")).alias("age")).first()
    if age is not None and age["age"] < seconds:
        return rows, []
    try:
        return compute(), []
    except Exception:
        if age is None:
            raise
        return rows, ["refresh_failed"]
