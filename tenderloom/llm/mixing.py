"""A training mix of several sources by target weights, in DataFrame functions only.

Sources in the order of code points (null last) weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all words. A target
stops at ``MOST`` times its source's own words; what is over is shared again by weight until no target is above.

The words of a source's documents, laid end to end, are packed into blocks of ``BLOCK``. The mix is a row of slots in
shards of ``SHARD``. Each shard draws how many of its slots each source gets from a multinomial distribution (one draw a
slot, counted). The j-th slot of a source takes block ``permute(j)``, where each round through the source is a
pseudorandom permutation of its own (swap-or-not, a bijection for any number of blocks); slots and blocks are then
joined by source and block. Draws settle exactly: slots that a source drew beyond its due go, in order, to the sources
that drew too few, so that a source's words miss its target by no more than a block or two and no block is taken more
than ``MOST`` times. Random numbers are whole-number functions of slot, source and round, so every run agrees.

A null text has no words. A null source is a source; its documents and those of a source without words take nothing if
there is nothing to take. Null ids and repeated rows are rows like any other: order within a source goes by id and
size, and rows alike in both are alike in all that is returned, too. Very long texts span many blocks. No documents give
no rows. Other columns are not read.

Hot sources: running word counts are made in chunks of about ``CHUNK`` documents dealt by id, then over chunks; counts
of draws by shard, then over groups of shards. No task holds a source, and per-source tables are sent to every task only
while they are few (``shared.FEW_GROUPS``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.shared import FEW_GROUPS, Tables, beside_groups

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD = 1024
CHUNK = 8192
ROUNDS = 16
#: Shards that are summed up together before they are summed by source.
SHARD_GROUP = 1024
#: Range parts of the per-source table.
SOURCE_PARTS = 64
#: A prime: residues multiply within 63 bits.
PRIME = (1 << 31) - 1
_A, _B, _C = 1103515245, 612345671, 1597334677


def hashed(x: Column, key: Column) -> Column:
    """A whole number below ``PRIME`` for x (0 to 2**61) and key (0 to ``PRIME``)."""
    a = (x.bitwiseAND(F.lit(PRIME)) * _A + F.shiftright(x, 31) * _B + key) % PRIME
    return (a * a % PRIME * _C + a) % PRIME


def wide(x: Column, key: Column) -> Column:
    """A whole number below 2**61."""
    return hashed(x, key % PRIME) * (1 << 30) + hashed(x, (key + 7919) % PRIME) % (1 << 30)


def div(x: Column, by: Column | int) -> Column:
    return F.call_function("div", x, by if isinstance(by, Column) else F.lit(by))


def turn_keys(index: Column, turn: int, blocks: Column) -> Column:
    """The keys of the permutation that source ``index`` uses in its round ``turn`` through its blocks."""
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.transform(rounds, lambda r: wide(index * MOST + turn, r + 1) % F.greatest(blocks, F.lit(1)))


def permuted(j: Column, blocks: Column, keys: Column) -> Column:
    """Where j (0 to blocks - 1) goes: in each round a number and its partner change places or not, by the larger one's hash."""

    def swap(x: Column, key: Column) -> Column:
        y = (key + blocks - x) % blocks
        top = F.greatest(x, y)
        h = (top.bitwiseAND(F.lit(PRIME)) * _A + F.shiftright(top, 31) * _B + key % PRIME) % PRIME
        return F.when(F.shiftright(h * h % PRIME, 15) % 2 == 1, y).otherwise(x)

    return F.aggregate(keys, j, swap)


def running(rows: DataFrame, part: str, order: str, **sums: str) -> DataFrame:
    """``rows`` with each output name of ``sums``: the sum of its column over all rows before, by part and order.

    Parts are few and lie in order; sums run within each and over the parts' totals.
    """
    totals = rows.groupBy(part).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(part).alias("__part"), *[F.coalesce(F.sum(f"__{n}").over(over), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = each.join(F.broadcast(base), F.col(part) == F.col("__part"))
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def found(points: DataFrame, at: str, intervals: DataFrame, begin: str, end: str, total: int, few: bool) -> DataFrame:
    """``points`` joined to the interval that holds ``at``; intervals don't overlap and lie in 0 to ``total``.

    Both sides meet in equal cells of the line, some for each interval: an equality join with a bound rest.
    """
    cells = 1024 if few else 4 * intervals.count()
    size = max(1, total // cells)
    held = intervals.filter(F.col(end) > F.col(begin))
    spread = held.withColumn("__cell", F.explode(F.sequence(div(F.col(begin), size), div(F.col(end) - 1, size))))
    spread = F.broadcast(spread) if few else spread
    inside = (F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))
    return points.withColumn("__at", div(F.col(at), size)).join(spread, (F.col("__at") == F.col("__cell")) & inside).drop("__at", "__cell")


def source_table(sizes: DataFrame, tables: Tables) -> DataFrame:
    """source, index (0 on, by code point, null last), part, documents, words, weight, blocks; written once."""
    each = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("words"))
    parted = tables.write("source-parts", each.repartitionByRange(SOURCE_PARTS, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    numbered = parted.select("*", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())).cast("long").alias("place"), F.lit(1).cast("long").alias("one"))
    indexed = running(numbered, "part", "place", index="one").drop("place", "one")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("index") % len(WEIGHTS) + 1).cast("int"))
    return tables.write("sources", indexed.select("*", weight.cast("long").alias("weight"), div(F.col("words") + BLOCK - 1, BLOCK).alias("blocks")))


def fill_level(sources: DataFrame) -> float:
    """The words that a weight of one gets once no target is above ``MOST`` times its source.

    Each turn caps the sources whose share is above; the level rises until no more are.
    """
    words = sources.agg(F.sum("words")).first()[0] or 0
    level, capped = 0.0, -1
    while words:
        over = F.col("weight") * F.lit(level) > F.lit(MOST) * F.col("words")
        n, filled, weight = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.lit(MOST) * F.col("words")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == capped:
            break
        level, capped = (SHARE * words - filled) / weight, n
    return level


@dataclass
class Mix:
    """``sources``: a row each, with target, slots drawn and blocks; ``slots``: shard, index, block, turn, a row for each
    slot; ``docs``: the kept columns with size, index and first: where the document's words begin in its source's row."""

    sources: DataFrame
    slots: DataFrame
    docs: DataFrame
    few: bool


def draw(spark, sources: DataFrame, total: int, few: bool) -> DataFrame:
    """shard, index, n: how many of a shard's slots each source gets, from one draw a slot."""
    slot = spark.range(total).select(F.col("id"), div(F.col("id"), SHARD).alias("shard"), (wide(F.col("id"), F.lit(20011)) % total).alias("at"))
    drawn = found(slot, "at", sources.select("index", F.col("first_slot").alias("begin"), (F.col("first_slot") + F.col("due")).alias("end")), "begin", "end", total, few)
    return drawn.groupBy("shard", "index").agg(F.count("*").alias("n"))


def slots_of(counts: DataFrame) -> DataFrame:
    """shard, index, j: the slots of ``counts``, numbered in each source over all shards."""
    group = div(F.col("shard"), SHARD_GROUP)
    counts = counts.withColumn("group", group)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("index", "group").agg(F.sum("n").alias("in_group"))
    groups = groups.withColumn("earlier", F.coalesce(F.sum("in_group").over(before("index").orderBy("group")), F.lit(0))).drop("in_group")
    inside = F.coalesce(F.sum("n").over(before("index", "group").orderBy("shard")), F.lit(0))
    placed = counts.withColumn("inside", inside).join(groups, ["index", "group"])
    return placed.select("shard", "index", F.explode(F.sequence(F.col("earlier") + F.col("inside"), F.col("earlier") + F.col("inside") + F.col("n") - 1)).alias("j"))


def settled(slots: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``slots`` with what a source drew beyond its due given to those that drew too few; sources have drawn, due, over_first, under_first."""
    mine = sources.select(F.col("index").alias("of"), "due", "over_first")
    numbered = slots.join(F.broadcast(mine) if few else mine, F.col("index") == F.col("of")).drop("of")
    kept = numbered.filter(F.col("j") < F.col("due")).select("shard", "index", "j")
    surplus = numbered.filter(F.col("j") >= F.col("due")).select("shard", (F.col("over_first") + F.col("j") - F.col("due")).alias("at"))
    short = sources.select("index", F.col("drawn"), F.col("under_first").alias("begin"), (F.col("under_first") + F.greatest(F.col("due") - F.col("drawn"), F.lit(0))).alias("end"))
    total = sources.agg(F.sum(F.greatest(F.col("due") - F.col("drawn"), F.lit(0)))).first()[0] or 0
    given = found(surplus, "at", short, "begin", "end", total, few).select("shard", "index", (F.col("drawn") + F.col("at") - F.col("begin")).alias("j"))
    return kept.unionByName(given)


def packed(sizes: DataFrame, sources: DataFrame, id_column: str) -> DataFrame:
    """``sizes`` with index and first; chunks of each source are dealt by id and size and summed up one after the other."""
    rows = beside_groups(sizes, sources.select("source", "index", F.col("documents").alias("__n")), "source")
    named = F.coalesce(F.pmod(F.col(id_column).cast("long"), F.lit(1 << 60)), F.lit(0))
    chunk = hashed(named + F.col("size") % (1 << 30), F.lit(31).cast("long")) % div(F.col("__n") + CHUNK - 1, CHUNK)
    rows = rows.withColumn("chunk", chunk).drop("__n")
    chunks = rows.groupBy("index", "chunk").agg(F.sum("size").alias("held"))
    earlier = F.coalesce(F.sum("held").over(Window.partitionBy("index").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("index", "chunk").orderBy(F.col(id_column).asc_nulls_last(), "size")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).withColumn("place", F.row_number().over(order))
    starts = chunks.select(F.col("index").alias("of"), F.col("chunk").alias("of_chunk"), earlier.alias("earlier"))
    joined = placed.join(starts, (F.col("index") == F.col("of")) & (F.col("chunk") == F.col("of_chunk")))
    return joined.withColumn("first", F.col("earlier") + F.col("inside")).drop("of", "of_chunk", "earlier", "inside")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", with_text: bool = False) -> Mix:
    """Draws the mix; with ``with_text`` its documents keep their texts, for ``block_texts``."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORDS)), F.lit(0)).cast("long")
    kept = [F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.alias("size")]
    sizes = tables.write("sizes", docs.select(*kept, *[F.col(text_column).alias("text")] * with_text))
    sources = source_table(sizes, tables)
    tables.drop("source-parts")
    few = sources.count() <= FEW_GROUPS
    level = fill_level(sources)
    over = F.col("weight") * F.lit(level) > F.lit(MOST) * F.col("words")
    target = F.when(over, (F.lit(MOST) * F.col("words")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    rounded = F.floor(target * F.col("blocks") / F.col("words") + 0.5)
    due = F.when(F.col("words") == 0, 0).when(over, F.lit(MOST) * F.col("blocks")).otherwise(F.least(F.lit(MOST) * F.col("blocks"), rounded)).cast("long")
    aimed = running(sources.withColumn("target", target).withColumn("due", due), "part", "index", first_slot="due")
    total = sources.select(due.alias("due")).agg(F.sum("due")).first()[0] or 0
    if not total:
        none = spark.createDataFrame([], "shard long, index long, turn int, block long")
        return Mix(aimed, none, packed(sizes, aimed, "doc_id"), few)
    aimed = tables.write("aimed", aimed)
    counts = tables.write("counts", draw(spark, aimed, total, few))
    drawn = counts.groupBy(F.col("index").alias("of")).agg(F.sum("n").alias("drawn"))
    known = aimed.join(drawn, F.col("index") == F.col("of"), "left").drop("of").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    spare = known.withColumn("over", F.greatest(F.col("drawn") - F.col("due"), F.lit(0))).withColumn("under", F.greatest(F.col("due") - F.col("drawn"), F.lit(0)))
    aimed = tables.write("drawn", running(spare, "part", "index", over_first="over", under_first="under"))
    slots = settled(slots_of(counts), aimed, few)
    keys = aimed.select(F.col("index").alias("of"), "blocks", F.array(*[turn_keys(F.col("index"), t, F.col("blocks")) for t in range(MOST)]).alias("keys"))
    placed = slots.join(F.broadcast(keys) if few else keys, F.col("index") == F.col("of")).withColumn("turn", div(F.col("j"), F.col("blocks")).cast("int"))
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.get("keys", F.col("turn")))
    return Mix(aimed, placed.select("shard", "index", "turn", block.alias("block")), packed(sizes, aimed, "doc_id"), few)


def pieces(docs: DataFrame) -> DataFrame:
    """The packed documents, one row for each block that holds words of theirs: block, from_word, n_words. One without words has one row of nulls."""
    last = F.col("first") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(div(F.col("first"), BLOCK), div(last - 1, BLOCK)))
    cut = docs.withColumn("block", F.explode_outer(blocks))
    begin, end = F.greatest(F.col("first"), F.col("block") * BLOCK), F.least(last, (F.col("block") + 1) * BLOCK)
    return cut.withColumn("from_word", begin - F.col("first")).withColumn("n_words", end - begin)


def taken(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    times = mixed.slots.groupBy(F.col("index").alias("of"), F.col("block").alias("of_block")).agg(F.count("*").alias("times"))
    cut = pieces(mixed.docs.select("doc_id", "size", "index", "chunk", "place", "first"))
    joined = cut.join(times, (F.col("index") == F.col("of")) & (F.col("block") == F.col("of_block")), "left")
    # One number names the row in its source's chunk.
    words = joined.groupBy("index", "chunk", "place", "doc_id", "size").agg(F.sum(F.coalesce(F.col("n_words") * F.col("times"), F.lit(0))).alias("taken"))
    about = mixed.sources.select(F.col("index"), F.col("words").alias("source_size"), "target", F.col("documents").alias("__n"))
    return beside_groups(words, about, "index").select("doc_id", "size", "source_size", "target", "taken")


def block_texts(mixed: Mix) -> DataFrame:
    """shard, source, block, turn, text: the words of each slot of the mix, joined by blanks; needs ``mix(..., with_text=True)``."""
    docs = mixed.docs.filter("size > 0")
    last = F.col("first") + F.col("size")
    words = docs.withColumn("__words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))

    def cut(block: Column) -> Column:
        begin, end = F.greatest(F.col("first"), block * BLOCK), F.least(last, (block + 1) * BLOCK)
        held = F.slice(F.col("__words"), (begin - F.col("first") + 1).cast("int"), (end - begin).cast("int"))
        return F.struct(block.alias("block"), begin.alias("begin"), F.array_join(held, " ").alias("held"))

    parts = words.select("index", "source", F.inline(F.transform(F.sequence(div(F.col("first"), BLOCK), div(last - 1, BLOCK)), cut)))
    in_order = F.array_sort(F.collect_list(F.struct("begin", "held")))
    texts = parts.groupBy("index", "source", "block").agg(F.array_join(F.transform(in_order, lambda p: p["held"]), " ").alias("text"))
    return mixed.slots.join(texts, ["index", "block"]).select("shard", "source", "block", "turn", "text")
