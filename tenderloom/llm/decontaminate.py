"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A seed hashes six of eight
neighbouring tokens; the two masks together hit every stretch of 13 tokens with any two of them replaced. Seeds of
the benchmark and of every document meet in a hash join; around each hit the item is laid over the document and
the longest stretch is taken that begins and ends with a match and of which more than four fifths agree (a match
counts 1, a replaced token -4, the sum is positive). A stretch of ``LEAST`` tokens or more, or of all an item's tokens if it has fewer, is contamination.
An item of fewer than eight tokens is one seed of all its tokens, and only an exact copy of it is contamination.

The benchmark side is broadcast in blocks of about ``BLOCK_TOKENS`` tokens (an item is never cut, so the longest item
may add to that), one at a time: a block is read, its pass over the documents written, and its broadcast given up
before the next is read. A benchmark of more tokens takes more passes, not more memory. Documents are never shuffled.
A seed that many places share is expanded ``HITS`` hits at a time.

Defined results: null and empty texts are clean and match nothing; items without a
token are no evidence; repeated rows are judged one by one; of equally long stretches the one furthest left in the
document is reported; an empty benchmark leaves all documents clean; columns not named in ``keep`` are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.shared import materialise
from tenderloom.llm.words import WORD_BYTE, blocks, in_text, mix, tokenise

#: Token positions that a seed looks at.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
LEAST = 13
MISMATCH = -4
BLOCK_TOKENS = 1_000_000
#: Pairs of a document's and an item's place that are held at once.
HITS = 1_000_000

HIT = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("overlap_tokens", T.LongType()),
        T.StructField("matched_tokens", T.LongType()),
        T.StructField("doc_token", T.LongType()),
        T.StructField("item_token", T.LongType()),
    ]
)


def seeds(tokens: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask (hash, first token) of every place where ``SPAN`` tokens of one owner stand."""
    if len(tokens) < SPAN:
        return
    at = np.flatnonzero(owner[: len(tokens) - SPAN + 1] == owner[SPAN - 1 :])
    for no, mask in enumerate(MASKS):
        h = np.full(len(at), no + 1, np.uint64)
        for k in mask:
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + k]
        yield mix(h), at


def whole_seeds(tokens: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of every place where ``size`` tokens of one owner stand; all of them are looked at."""
    if len(tokens) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(tokens) - size + 1] == owner[size - 1 :])
    h = np.full(len(at), len(MASKS) + size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + k]
    return mix(h), at


class Index:
    """Seeds of some benchmark items, sorted, behind a bit table that most document seeds do not pass."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.tokens, _, owner, _ = tokenise([(t or "").encode() for _, t in items], WORD_BYTE)
        self.bounds = in_text(owner, len(items))
        found = list(seeds(self.tokens, owner))
        h = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        at = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        sizes = np.diff(self.bounds)
        self.short = {}
        for size in np.unique(sizes[(sizes > 0) & (sizes < SPAN)]).tolist():
            whole, begin = whole_seeds(self.tokens, owner, size)
            mine = sizes[owner[begin]] == size
            by_hash = np.argsort(whole[mine], kind="stable")
            self.short[size] = whole[mine][by_hash], owner[begin[mine]][by_hash]
        order = np.argsort(h, kind="stable")
        self.h, self.at, self.owner = h[order], at[order], owner
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(h)) * 64))))
        table = np.zeros(1 << self.bits, bool)
        table[(self.h >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.table = np.packbits(table, bitorder="little")

    def _likely(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.flatnonzero(self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def hits(self, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (item number, document number, shift): shift is the document token under the item's first."""
        out = []
        for h, at in seeds(tokens, owner):
            likely = self._likely(h)
            a, b = np.searchsorted(self.h, h[likely]), np.searchsorted(self.h, h[likely], side="right")
            real = np.flatnonzero(b > a)
            likely, a, n = likely[real], a[real], (b - a)[real]
            cuts = np.searchsorted(np.cumsum(n), np.arange(HITS, n.sum() + HITS, HITS), side="right") if len(n) else []
            for s, e in zip([0, *cuts], [*cuts, len(n)], strict=True):
                m = n[s:e]
                doc_at = np.repeat(at[likely[s:e]], m)
                item_at = self.at[np.repeat(a[s:e] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                item = self.owner[item_at]
                out.append(np.unique(np.stack([item, owner[doc_at], doc_at - (item_at - self.bounds[item])], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def copies(self, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(item number, document number, shift) of the first exact copy of every item of fewer than SPAN tokens."""
        out = []
        for size, (known, items) in self.short.items():
            h, at = whole_seeds(tokens, owner, size)
            a, b = np.searchsorted(known, h), np.searchsorted(known, h, side="right")
            likely = np.flatnonzero(b > a)
            # Of a document's places with one seed the first is enough.
            _, first = np.unique(np.stack([owner[at[likely]], a[likely]], axis=1), axis=0, return_index=True)
            likely = likely[first]
            n = (b - a)[likely]
            doc_at = np.repeat(at[likely], n)
            item = items[np.repeat(a[likely] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append(np.stack([item, owner[doc_at], doc_at], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def overlap(self, item: int, tokens: np.ndarray, low: int, high: int, shift: int) -> tuple[int, int, int, int] | None:
        """(length, matches, document token, item token) of the best stretch, if it is long enough."""
        a, b = self.bounds[item], self.bounds[item + 1]
        left, right = max(low - shift, 0), min(high - shift, b - a)
        same = tokens[shift + left : shift + right] == self.tokens[a + left : a + right]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
        ends = np.flatnonzero(same) + 1
        if not len(ends):
            return None
        # The running minimum over places where a match begins never rises: the first one under an end's total is the
        # furthest start from which that end is still reached with a positive sum.
        lowest = np.minimum.accumulate(total[ends - 1])
        starts = ends[np.searchsorted(-lowest, 1 - total[ends])] - 1
        best = int((ends - starts).argmax())
        start, end = int(starts[best]), int(ends[best])
        if end - start < min(LEAST, b - a):
            return None
        return end - start, int(same[start:end].sum()), int(shift + left + start - low), int(left + start)


def tokens_in(text: Column) -> Column:
    """How many tokens a text has: runs of ASCII letters and digits and of all characters that are not ASCII."""
    return F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The items (item_id, text), repeated rows once, in blocks of about ``BLOCK_TOKENS`` tokens, one at a time."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(tokens_in(F.col("text"))).alias("n")).first()["n"] or 0
    n = -(-size // BLOCK_TOKENS)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = [(r["item_id"], r["text"]) for r in part.collect()]
        if rows:
            yield Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _each_block(benchmark: DataFrame, work) -> Iterator[DataFrame]:
    """``work(index as a broadcast)`` for each block. All results but the last are written before the next block is read."""
    spark = benchmark.sparkSession
    blocks_of, shared, made = benchmark_blocks(benchmark), None, None
    for index in blocks_of:
        if shared is not None:
            yield materialise(made, "decontaminate")
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)
        made = work(shared)
    if made is not None:
        yield made


def _judged(shared, texts: pa.Array) -> Iterator[tuple[int, tuple[int, int, int, int, int]]]:
    """(text number, hit) of the best stretch of every item in every text."""
    index = shared.value
    for first, part in blocks(texts):
        tokens, _, owner, _ = tokenise(part, WORD_BYTE)
        bounds = in_text(owner, len(part))
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for item, doc, shift in [*index.hits(tokens, owner).tolist(), *index.copies(tokens, owner).tolist()]:
            got = index.overlap(item, tokens, bounds[doc], bounds[doc + 1], shift)
            if got and ((doc, item) not in best or (got[0], -got[2]) > (best[doc, item][0], -best[doc, item][2])):
                best[doc, item] = got
        for (doc, item), got in best.items():
            yield first + doc, (int(index.ids[item]), *got)


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each document and item that overlap: ``keep`` columns, item_id, overlap_tokens, matched_tokens, doc_token, item_token."""
    schema = T.StructType([*[docs.schema[c] for c in keep], *HIT.fields])
    rows, out = docs.select(*keep, F.col("text").alias("__text")), None

    def work(shared) -> DataFrame:
        def run(batches):
            for batch in batches:
                found = list(_judged(shared, batch.column("__text")))
                at = pa.array([i for i, _ in found], pa.int64())
                values = [pa.array([h[k] for _, h in found], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], *values], names=[*keep, *HIT.names])

        return rows.mapInArrow(run, schema)

    for one in _each_block(benchmark, work):
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least_tokens: int = 4) -> DataFrame:
    """The documents, with all their columns, in which no item of ``least_tokens`` tokens or more overlaps.

    Shorter items are common words and phrases, which tell nothing of a text that holds them; ``contaminated`` reports them.
    """
    benchmark = benchmark.filter(tokens_in(F.col("text")) >= least_tokens)
    left = [docs]

    def work(shared) -> DataFrame:
        def run(batches):
            for batch in batches:
                bad = {i for i, _ in _judged(shared, batch.column("text"))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        return left[-1].mapInArrow(run, docs.schema)

    for one in _each_block(benchmark, work):
        left.append(one)
    return left[-1]
