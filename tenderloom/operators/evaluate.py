"""Ranking quality: recall, reciprocal rank, hits, slices, paired bootstrap, acceptance."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_metrics(rows: DataFrame, depth: int = 100) -> DataFrame:
    """Per query (candidates, participants, winner): recall, winner recall, reciprocal rank, hits. A miss counts 0."""
    top = F.slice("candidates", 1, depth)
    place = F.array_position(top, F.col("winner"))
    hit = lambda n: (place.between(1, n)).cast("double")
    found = lambda n: F.size(F.array_intersect(F.slice("candidates", 1, n), "participants"))
    many = F.greatest(F.size("participants"), F.lit(1))
    return rows.withColumns(
        {
            "recall": found(depth) / many,
            "winner_recall": (place > 0).cast("double"),
            "mrr": F.when(place > 0, 1.0 / place).otherwise(0.0),
            **{f"hit_{n}": hit(n) for n in (1, 5, 10, 20)},
            "bidder_hit_10": (found(10) > 0).cast("double"),
            "participant_recall_10": found(10) / many,
        }
    )


METRICS = ("recall", "winner_recall", "mrr", "hit_1", "hit_5", "hit_10", "hit_20", "bidder_hit_10", "participant_recall_10")


def summary(metrics: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def slices(text: Column, items: Column, history: Column) -> Column:
    """The slices a query belongs to: by length, number of items and history."""
    short = F.size(F.split(F.trim(text), r"\s+")) <= 4
    return F.array(
        F.when(short, "short").otherwise("long"),
        F.when(items > 1, "multi").otherwise("single"),
        F.when(history == 0, "no_history").when(history < 10, "small_history").otherwise("large_history"),
    )


def grouped_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and reciprocal rank over groups with exactly one winner: rows (group_id, score, label, id)."""
    one = rows.groupBy("group_id").agg(
        F.sum("label").alias("winners"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").cast("string").alias("id"), "label"))).alias("order"),
    )
    place = F.array_position(F.transform("order", lambda x: x["label"]), 1)
    return one.filter("winners = 1").select(place.alias("place")).agg(F.count("*").alias("groups"), F.round(F.avg((F.col("place") == 1).cast("double")), 6).alias("accuracy"), F.round(F.avg(1.0 / F.col("place")), 6).alias("mrr"))


def paired_bootstrap(deltas: DataFrame, cluster: str, delta: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(mean, low, high) of a paired difference, resampled by cluster.

    Each cluster draws its own Poisson(1) weight in every resample from the MD5 of (seed, resample, cluster), so the
    draws need no sample to be gathered: a cluster is expanded into its non-zero weights and summed by resample.
    """
    sums = deltas.groupBy(cluster).agg(F.sum(delta).alias("total"), F.count("*").alias("n"))
    draws = sums.select("total", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda r: F.struct(r.alias("resample"), F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), F.col(cluster).cast("string")).cast("binary")), F.lit(10)), 16, 10).cast("double").alias("u")))).alias("d"))
    u = F.col("d.u") / float(1 << 40)
    weight, below, p = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):
        below += p
        weight = weight + (u >= below).cast("int")
        p /= k + 1
    weighed = draws.withColumn("w", weight).filter("w > 0")
    means = weighed.groupBy("d.resample").agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    ci = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).first()["ci"] or [None, None]
    return deltas.agg(F.avg(delta).alias("mean")).withColumns({"low": F.lit(ci[0]).cast("double"), "high": F.lit(ci[1]).cast("double")})


def accepted(mrr: dict[str, float], bidder_before: float, bidder_after: float, slack: float = 0.01) -> bool:
    """Better on average, better at the lower bound, and bidders not lost beyond the slack."""
    return mrr["mean"] > 0 and mrr["low"] > 0 and bidder_after >= bidder_before - slack


def check_splits(splits: Sequence[dict], gap_days: int = 30) -> None:
    """Named train, validation, test in order, without overlap, and history ending ``gap_days`` before each start."""
    if [s["name"] for s in splits] != ["train", "validation", "test"]:
        raise ValueError("splits must be train, validation, test")
    end = None
    for s in splits:
        before, start, stop = (date.fromisoformat(s[k]) for k in ("history_before", "start", "end"))
        if start - before < timedelta(days=gap_days) or stop <= start or (end is not None and start < end):
            raise ValueError(f"split {s['name']} overlaps or has no gap")
        end = stop


def cases(lots: DataFrame, participations: DataFrame, after: str, exclude: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """Evaluation cases: lots after a date with exactly one winner, not excluded; with ``most``, so many in seeded order."""
    won = participations.groupBy("lot_id").agg(
        F.max(F.when(F.col("is_winner"), F.col("supplier_inn"))).alias("winner"), F.count_if("is_winner").alias("winners"), F.sort_array(F.collect_set("supplier_inn")).alias("participants")
    ).filter("winners = 1")
    late = lots.filter(F.col("publish_date") > F.lit(after).cast("date")).select("lot_id", "query_text").join(exclude.select("lot_id"), "lot_id", "left_anti")
    out = late.join(won.drop("winners"), "lot_id")
    return out if most is None else out.orderBy(F.xxhash64("lot_id", F.lit(seed)), "lot_id").limit(most)


def mention(text: Column, product: Column, limit: int) -> Column:
    """Where a product is named in a card: struct(at, kept); at is 0-based or -1, kept if it lies within the limit."""
    at = F.instr(F.lower(text), F.lower(product)) - 1
    return F.struct(at.alias("at"), ((at >= 0) & (at + F.length(product) <= limit)).alias("kept"))
