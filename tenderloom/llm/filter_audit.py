"""What five quality filters take from a corpus, one by one, together and in every order.

``scan`` reads the Arrow buffers of whole texts: byte classes and prefix sums count words, capitals and symbols, and
sorted word hashes, verified on the words' bytes, count distinct words. Each text ends as a mask of the filters it
fails; everything else is sums over masks: an order removes a text at the first of its failing filters.

Filters (words are maximal runs of other bytes than the six ASCII blanks, case counts):
A fewer than ``LEAST_WORDS`` words; B fewer distinct words than half of the words; C more than 3 capitals A-Z in 100
code points; D one of ``SYMBOLS``; E the same text stands under a smaller doc_id, removed or not.

Null texts count as empty (they fail A); an empty text has no words, so B and C let it pass. A null language counts as
the empty string. A row without a doc_id is nobody's predecessor and has none: it never fails E. Rows that repeat a
doc_id and a text don't fail E for each other, and each counts. Labels that repeat a doc_id count once: good, if any
row says so, and toxic likewise; labels without a doc_id say nothing. Very long texts are scanned in one piece. An
empty table has no parts, so no rows. Columns beside those named here are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.words import NOT_BLANK, mix, powers, prefix_hash, spans

FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_CAPITAL = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_POINT = (np.arange(256) & 0xC0) != 0x80


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins and the last ends) of a string or binary array, from its own memory; a null is empty."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands."""
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    return mix((h[end] - h[begin]) * down[begin] + (end - begin).astype(np.uint64))


def distinct_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Distinct words of each text.

    Hashes are sorted within their text and neighbours of one hash are compared byte by byte. A text in which two
    different words share a hash is counted from the words themselves.
    """
    key = word_hashes(data, begin, end)
    order = np.lexsort((key, owner))
    key, owner, begin, end = key[order], owner[order], begin[order], end[order]
    same = np.flatnonzero((owner[1:] == owner[:-1]) & (key[1:] == key[:-1]))
    out = np.bincount(owner, minlength=texts) - np.bincount(owner[same], minlength=texts)
    length = end[same] - begin[same]
    unlike = length != end[same + 1] - begin[same + 1]
    alike = np.flatnonzero(~unlike)
    n = length[alike]
    first = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(first, n)
    differs = data[np.repeat(begin[same[alike]], n) + step] != data[np.repeat(begin[same[alike] + 1], n) + step]
    if len(alike):
        unlike[alike] = np.add.reduceat(np.append(differs, False).astype(np.int64), first) > 0
    for text in np.unique(owner[same[unlike]]):
        mine = slice(*np.searchsorted(owner, [text, text + 1]))
        out[text] = len({data[a:b].tobytes() for a, b in zip(begin[mine], end[mine], strict=True)})
    return out


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct words, capitals, symbols and code points of each text."""
    data, at = buffers(texts)
    inside = NOT_BLANK[data]
    held = np.flatnonzero(np.diff(at))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[held]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[held + 1] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1

    def within(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    owner = np.searchsorted(at, begin, side="right") - 1
    return {
        "words": np.bincount(owner, minlength=len(at) - 1),
        "distinct": distinct_words(data, begin, end, owner, len(at) - 1),
        "capitals": within(_CAPITAL[data]),
        "symbols": within(_SYMBOL[data]),
        "points": within(_POINT[data]),
    }


def failed(c: dict[str, np.ndarray]) -> np.ndarray:
    """The filters A to D that each text fails, as bits 0 to 3."""
    return (
        (c["words"] < LEAST_WORDS).astype(np.int32)
        | (100 * c["distinct"] < 50 * c["words"]).astype(np.int32) << 1
        | (100 * c["capitals"] > 3 * c["points"]).astype(np.int32) << 2
        | (c["symbols"] > 0).astype(np.int32) << 3
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), mask: the text's own filters A to D as bits. One row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("mask", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for first, texts in spans(batch.column("text")):
                kept = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "part", "digest")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(failed(counts(texts)), pa.int32())], names=["doc_id", "part", "digest", "mask"])

    return rows.mapInArrow(run, schema)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (filters A to E as bits 0 to 4), n, good, toxic: documents, a row for each part and mask that occurs.

    Documents are counted by (doc_id, part, text) first, so that a text of many copies stays spread; the smallest
    doc_id of a text is then the smallest of a few counted rows.
    """
    rows = scan(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("said_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id are spread by their text; no label has such a key.
    aside = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part"))
    rows = rows.withColumn("aside", F.coalesce(aside, F.lit(0))).join(said.withColumn("said_aside", F.lit(0).cast("long")), (F.col("doc_id") == F.col("said_id")) & (F.col("aside") == F.col("said_aside")), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    counted = rows.select("doc_id", "part", "mask", "digest", "n", *flags).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), nameless.alias("nameless"))
    lowest = F.min("least").over(Window.partitionBy("digest"))
    first = F.when(F.col("least") == F.col("lowest"), F.col("at_least")).otherwise(0) + F.col("nameless")
    split = F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))
    parted = counted.withColumn("lowest", lowest).select("part", "good", "toxic", F.inline(split)).filter("n > 0")
    flagged = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return parted.groupBy("part", "mask").agg(F.sum("n").alias("all"), flagged("good"), flagged("toxic")).withColumnRenamed("all", "n")


def steps(spark) -> DataFrame:
    """filter_order, step, filter (bit number) and before (bits of the filters applied earlier): 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        bits = [FILTERS.index(f) for f in order]
        rows += [("".join(order), i + 1, bits[i], sum(1 << b for b in bits[:i])) for i in range(len(bits))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the module's text for the filters.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost: documents of the part. shapley: what the filter
    removes, summed over all orders; each of the k filters that a text fails is first in one k-th of them.
    """
    bit = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda of, when: F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")
    here = fails & ~earlier
    # 5 filters, 16 sets of others before each: what a step does depends on no more.
    pairs = [(f, b) for f in range(5) for b in range(32) if not b >> f & 1]
    taken = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in pairs])
    done = (
        cells(docs, labels)
        .select("*", F.inline(taken))
        .groupBy("part", "filter", "before")
        .agg(
            total("n", (F.col("mask").bitwiseAND(F.col("before").bitwiseOR(bit))) == 0).alias("kept"),
            total("n", here).alias("removed"),
            total("n", fails & earlier).alias("redundant"),
            total("n", F.col("mask") == bit).alias("unique_fails"),
            total("good", here).alias("good_lost"),
            total("toxic", here).alias("toxic_lost"),
            F.coalesce(F.sum(F.when(fails, F.col("n") * _orders_first())), F.lit(0)).cast("long").alias("shapley"),
        )
    )
    orders = F.broadcast(steps(docs.sparkSession))
    return done.join(orders, ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders_first() -> Column:
    """In how many of the 120 orders a given one of a mask's filters comes before its others."""
    return F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1)))
