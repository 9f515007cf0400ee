"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input, and never cross documents. The work is done in four steps, none of which gathers a document's
or a passage's copies in one place:

1. Whole copies: of equal texts all but those with the smallest id go as a whole.
2. Shared grams: every string of ``LENGTH`` bytes holds a gram of ``GRAM`` bytes that has the least hash of all its
   grams. Only these are dealt by hash, one for each task's run of texts, and come back to their documents if another
   document holds them. Strings whose grams are not shared need no further look.
3. Suffixes: the remaining strings are the suffixes, cut at ``LENGTH`` bytes, that start where their own least gram
   is shared. They are dealt by that gram as short runs of bytes, equal runs of a block of texts once. In a shard every
   batch of them gets a suffix array: they are sorted by their bytes, eight at a time. It is merged along each level
   that the shard has: a suffix finds its neighbours there, column by column, and meets a match where all ``LENGTH``
   bytes agree. Then it becomes a level itself; levels of equal size merge, so that there are logarithmically many.
   Of two suffixes that match the one with the larger id is marked and leaves.
4. Marks go back to the documents, and what they cover is cut out.

Hashes choose which strings are looked at and where; that two strings are equal is always found on their bytes. The
number of shards follows the bytes of text and the strings with shared grams, so a shard stays as large whatever the
table. What is dealt are packed rows, one for each pair of a sender and a receiver; both are large (tens of megabytes of
text), so that the pairs, whose number grows with the square of the table, are few. A receiver of suffixes is worked
through in ``FOLD`` shards, one after the other, so that its memory is that of one.

Defined results: null and empty texts, and texts under ``LENGTH`` bytes, lose nothing; rows with equal ids never
remove each other's bytes; a null id removes nothing and loses nothing; overlapping strings within one document do
not count; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.packing import items, pack, pack_rising, slices, unpack, unpack_rising
from tenderloom.llm.shared import Tables
from tenderloom.llm.words import blocks, mix, powers, prefix_hash

LENGTH, GRAM = 50, 20
#: Grams in a string: one of any WINDOW neighbouring grams is the least.
WINDOW = LENGTH - GRAM + 1
BLOCK = 4_000_000
#: Suffixes that make one batch of a shard's family.
BATCH = 100_000
#: Strings in each shard of suffixes, and the least number of ranges and shards.
SHARD_BYTES, LEAST_SHARDS = 800_000, 16
#: Shards of suffixes that one receiver works through, and the least number of receivers.
FOLD, LEAST_RECEIVERS = 8, 64
#: Shards' worth of text in each range of rows, and in each shard of grams.
RANGE, GRAM_SHARD = 12, 24
#: Grams that a task gathers before it deals them.
GRAMS = 1_000_000
#: Up to this many rows are named by broadcast to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Lower bits of an order key that hold a gram's place.
PLACE_BITS = 24
#: Bytes of text whose grams are worked out at once, and of texts that are dealt out together.
STEP = 262_144


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Grams:
    """Some texts, and for every string of LENGTH bytes in them its least gram.

    Grams are ordered by the upper bits of their hash, then from left to right. The place stands in the lower bits,
    so that a sliding minimum finds both; it only ever moves on with the string, so equal neighbours mark its runs.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.key, self.at, self.who, self.begin, self.count = np.zeros(0, np.uint64), none, none, none, none
        if n < LENGTH:
            return
        self.h = prefix_hash(self.data)
        _, self.down = powers(n + 1)
        gram = mix((self.h[GRAM:] - self.h[:-GRAM]) * self.down[: n - GRAM + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        m = _sliding((gram & ~low) | (np.arange(len(gram), dtype=np.uint64) & low), WINDOW, np.minimum)
        count = np.maximum(np.diff(self.bounds) - LENGTH + 1, 0)
        first = self.bounds[:-1]
        inside = np.zeros(len(m) + 1, np.int8)
        np.add.at(inside, first[count > 0], 1)
        np.add.at(inside, (first + count)[count > 0], -1)
        start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(start):
            return
        m = m[start]
        fresh = np.ones(len(m), bool)
        fresh[1:] = (m[1:] != m[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(fresh)
        self.begin = start[head]
        self.who = np.searchsorted(self.bounds, self.begin, side="right") - 1
        self.count = np.diff(np.append(head, len(m)))
        self.at = self.begin + ((m[head] - self.begin.astype(np.uint64)) & low).astype(np.int64)
        self.key = np.maximum(mix(gram[self.at]), np.uint64(1))  # mixed anew: least hashes are small, shards take equal ranges


def _steps(texts: list[bytes]):
    """(number of the first, texts) of runs of about STEP bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_range(rows: np.ndarray, parts: int, *more: np.ndarray):
    """(range, row keys, lengths, items...) for each range of row keys; items sorted by row, then as they stand."""
    where = rows % parts
    order = np.lexsort((rows, where))
    where, rows, more = where[order], rows[order], [m[order] for m in more]
    for r, a, b in zip(*slices(where), strict=True):
        names, begin, end = slices(rows[a:b])
        yield int(r), names, (end - begin).astype("<u4"), [m[a:b] for m in more]


GRAM_ROWS = "part int, kind string, keys binary, owner binary, rows binary"
GRAM_FLAGS = "part int, rows binary, spans binary, keys binary, n long"


def _grams_dealt(docs: DataFrame, shards: int, ranges: int) -> DataFrame:
    def dealt(found):
        keys, owner = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[fresh], owner[fresh]
        _, begin, end = slices(keys)
        many = np.repeat(end - begin > 1, end - begin)
        out: list[tuple] = []
        for r, rows, spans, (k,) in _by_range(owner[many], ranges, keys[many]):
            out.append((r, "flag", pack(k), pack(spans), pack(rows)))
        keys, owner = keys[begin], owner[begin]
        for p, a, b in zip(*slices(_part_of(keys, shards)), strict=True):
            mine, local = np.unique(owner[a:b], return_inverse=True)
            out.append((int(p), "gram", pack_rising(keys[a:b]), pack(local.astype("<u4")), pack(mine)))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), *[pa.array([x[i] for x in out], pa.binary()) for i in (2, 3, 4)]],
            names=["part", "kind", "keys", "owner", "rows"],
        )

    def run(batches):
        found, size = [], 0
        for batch in batches:
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            for first, texts in blocks(batch.column("text"), BLOCK):
                for s, some in _steps(texts):
                    g = Grams(some)
                    found.append((g.key, ids[first + s + g.who]))
                    size += len(g.key)
                    if size >= GRAMS:
                        yield dealt(found)
                        found, size = [], 0
        if found:
            yield dealt(found)

    return docs.select("row", "text").mapInArrow(run, GRAM_ROWS)


def _shared_grams(table: pa.Table, ranges: int) -> pa.Table:
    """Grams that two rows or more hold, for each of their rows; n is the number of such pairs."""
    keys, rows, out = [], [], []
    for x in table.to_pylist():
        if x["kind"] == "flag":
            out.append((x["part"], x["rows"], x["owner"], x["keys"]))
        else:
            keys.append(unpack_rising(x["keys"], "<u8"))
            rows.append(unpack(x["rows"], "<i8")[unpack(x["owner"], "<u4")])
    if keys:
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        for r, names, spans, (k,) in _by_range(row[same], ranges, key[same]):
            out.append((r, pack(names), pack(spans), pack(k)))
    columns = {c: pa.array([x[i] for x in out], pa.binary()) for i, c in ((1, "rows"), (2, "spans"), (3, "keys"))}
    return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), **columns, "n": pa.array([items(x[3]) for x in out], pa.int64())})


RUN_ROWS = "part int, kind string, rows binary, docs binary, owner binary, at binary, count binary, cuts binary, bytes binary"
MARKS = "part int, rows binary, spans binary, at binary, marks binary"


def _stretch(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of stretches."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether two stretches of each ``size`` (above 0) hold the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    return np.add.reduceat(data[_stretch(a, size)] != data[_stretch(b, size)], np.cumsum(size) - size) == 0


def _suffix_runs(texts: pa.Table, flags: pa.Table, ranges: int, receivers: int) -> pa.Table:
    """The runs of bytes in which a text's strings have shared grams, dealt by gram; equal runs of a block once.

    A receiver's runs stand in the order of its shards; ``cuts`` has the number of each."""
    flagged: dict[int, list[np.ndarray]] = {}
    for x in flags.to_pylist():
        spans = unpack(x["spans"], "<u4")
        for row, keys in zip(unpack(x["rows"], "<i8").tolist(), np.split(unpack(x["keys"], "<u8"), np.cumsum(spans)[:-1]), strict=True):
            flagged.setdefault(row, []).append(keys)
    out: list[tuple] = []
    dealt: list[tuple] = []
    pick = [i for i, row in enumerate(texts.column("row").to_pylist()) if row in flagged]
    texts = texts.take(pa.array(pick, pa.int64()))
    ids, docs = texts.column("row").to_numpy(), texts.column("doc_id").to_numpy()
    for first, part in blocks(texts.column("text").combine_chunks(), BLOCK):
        found, seen = [], 0
        for s, some in _steps(part):
            g = Grams(some)
            shared = np.zeros(len(g.key), bool)
            for i, a, b in zip(*slices(g.who), strict=True):
                shared[a:b] = np.isin(g.key[a:b], np.concatenate(flagged[int(ids[first + s + i])]))
            start, count, who = g.begin[shared], g.count[shared], g.who[shared]
            size = count + LENGTH - 1
            same = mix((g.h[start + size] - g.h[start]) * g.down[start] + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
            found.append((start - g.bounds[who], g.key[shared], who + s, count, size, same, np.cumsum(size) - size + seen, g.data[_stretch(start, size)]))
            seen += int(size.sum())
        at, key, who, count, size, same, place, data = (np.concatenate([f[i] for f in found]) for i in range(8))
        order = np.lexsort((docs[first + who], same, key))
        at, key, who, count, size, same, place = (v[order] for v in (at, key, who, count, size, same, place))
        repeat = np.zeros(len(at), bool)
        repeat[1:] = (key[1:] == key[:-1]) & (same[1:] == same[:-1]) & (size[1:] == size[:-1])
        head = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(at))))
        repeat[repeat] = _equal(data, place[repeat], place[head[repeat]], size[repeat])
        head[~repeat] = np.flatnonzero(~repeat)
        later = repeat & (docs[first + who] > docs[first + who[head]])
        full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
        for r, names, spans, (p, m) in _by_range(ids[first + who[later]], ranges, at[later], full[later]):
            out.append((r, "mark", pack(names), b"", pack(spans), pack(p.astype("<u4")), b"", b"", pack(m.astype("<u4"))))
        at, key, who, count, size, place = (v[~later] for v in (at, key, who, count, size, place))
        dealt.append((_part_of(key, receivers * FOLD), (first + who).astype(np.int32), at.astype("<u4"), count.astype(np.uint8), data[_stretch(place, size)]))
    if dealt:
        shard, who, at, count, data = (np.concatenate([d[i] for d in dealt]) for i in range(5))
        dealt.clear()
        size = count.astype(np.int64) + LENGTH - 1
        place = np.cumsum(size) - size
        order = np.argsort(shard, kind="stable")
        shard, who, at, count, size, place = (v[order] for v in (shard, who, at, count, size, place))
        for p, a, b in zip(*slices(shard // FOLD), strict=True):
            mine, local = np.unique(who[a:b], return_inverse=True)
            cuts = np.bincount(shard[a:b] % FOLD, minlength=FOLD).astype("<u4")
            out.append((int(p), "run", pack(ids[mine]), pack(docs[mine]), pack(local.astype("<u4")), pack(at[a:b]), pack(count[a:b]), pack(cuts), data[_stretch(place[a:b], size[a:b])].tobytes()))
    return pa.table(
        {"part": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.string())}
        | {c: pa.array([x[i] for x in out], pa.binary()) for i, c in enumerate(("rows", "docs", "owner", "at", "count", "cuts", "bytes"), 2)}
    )


def columns(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The LENGTH bytes from each place on as numbers that sort as the bytes do: eight bytes each, the last those left over."""
    if len(data) < LENGTH:
        return [np.zeros(0, np.uint64) for _ in range(-(-LENGTH // 8))]
    eight = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))  # eight bytes from any byte on
    out = [eight[at + i].astype(np.uint64) for i in range(0, LENGTH - 7, 8)]
    if LENGTH % 8:
        out.append(eight[at + LENGTH - 8].astype(np.uint64) & np.uint64((1 << 8 * (LENGTH % 8)) - 1))
    return out


def neighbours(level: list[np.ndarray], new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, matches) of each string of ``new`` in the sorted ``level``: the first not below it, and whether it is equal."""
    low, high = np.zeros(len(new[0]), np.int64), np.full(len(new[0]), len(level[0]), np.int64)
    for i, (have, want) in enumerate(zip(level, new, strict=True)):
        if not i:
            low, high = np.searchsorted(have, want), np.searchsorted(have, want, side="right")
            continue
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        want = want[open_]
        bounds = []
        for right in (False, True):
            a, b, left = low[open_], high[open_], np.arange(len(open_))
            while len(left):
                middle = (a[left] + b[left]) >> 1
                less = have[middle] <= want[left] if right else have[middle] < want[left]
                a[left[less]] = middle[less] + 1
                b[left[~less]] = middle[~less]
                left = left[a[left] < b[left]]
            bounds.append(a)
        low[open_], high[open_] = bounds
    return low, low < high


class SuffixFamily:
    """Levels of suffix arrays: strings in the order of their bytes, each with an id and a suffix number; of equal strings the one of the smallest id."""

    def __init__(self, suffixes: int):
        self.levels: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
        self.repeated = np.zeros(suffixes, bool)
        self.twin = np.arange(suffixes)

    def _lose(self, number: np.ndarray, ids: np.ndarray, least: np.ndarray, of: np.ndarray) -> None:
        """Suffixes with ids ``least`` and numbers ``of`` match these: larger ids are marked, equal ones share their marks."""
        self.repeated[number[ids > least]] = True
        tied = ids == least
        self.twin[number[tied]] = of[tied]

    def _array(self, text: list[np.ndarray], ids: np.ndarray, number: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The suffix array of a batch, with equal strings, of which the common prefix is the whole, settled."""
        order = np.lexsort((ids, *text[::-1]))
        text, ids, number = [c[order] for c in text], ids[order], number[order]
        first = np.ones(len(ids), bool)
        first[1:] = np.any([c[1:] != c[:-1] for c in text], axis=0)
        head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(ids) else np.zeros(0, np.int64)
        rest = ~first
        self._lose(number[rest], ids[rest], ids[head[rest]], number[head[rest]])
        return [c[first] for c in text], ids[first], number[first]

    def add(self, text: list[np.ndarray], ids: np.ndarray, number: np.ndarray) -> None:
        """Make the suffix array of a batch, merge it along the levels, and keep it; levels of like size merge."""
        new = self._array(text, ids, number)
        for level in self.levels:
            place, met = neighbours(level[0], new[0])
            there = place[met]
            self.repeated[new[2][met][new[1][met] > level[1][there]]] = True
            self.repeated[level[2][there][level[1][there] > new[1][met]]] = True
            tied = new[1][met] == level[1][there]
            self.twin[new[2][met][tied]] = level[2][there][tied]
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b))

    def _merged(self, a: tuple, b: tuple) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """One level of two: the strings of ``b`` step in at their places in ``a``; of equal ones the smaller id stays."""
        place, met = neighbours(a[0], b[0])
        there = place[met]
        a_ids, a_number = a[1].copy(), a[2].copy()
        smaller = b[1][met] < a_ids[there]
        a_ids[there[smaller]], a_number[there[smaller]] = b[1][met][smaller], b[2][met][smaller]
        fresh = ~met
        at = place[fresh] + np.arange(fresh.sum())
        old = np.ones(len(a_ids) + len(at), bool)
        old[at] = False

        def woven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), x.dtype)
            out[old], out[at] = x, y[fresh]
            return out

        return [woven(x, y) for x, y in zip(a[0], b[0], strict=True)], woven(a_ids, b[1]), woven(a_number, b[2])

    def marked(self) -> np.ndarray:
        """Marks of all suffixes; one tied to another has the other's mark too."""
        while True:
            more = self.repeated | self.repeated[self.twin]
            if (more == self.repeated).all():
                return more
            self.repeated = more


def _shard_marks(pieces: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, at, marks) of the runs with strings that also start in a document with a smaller id, among a shard's runs."""
    total = sum(int(p[3].sum()) for p in pieces)
    family, seen, held, size = SuffixFamily(total), 0, [], 0
    for i, piece in enumerate(pieces):
        held.append(piece)
        size += int(piece[3].sum())
        if size >= BATCH or i == len(pieces) - 1:
            docs, count, data = (np.concatenate([h[k] for h in held]) for k in (1, 3, 4))
            long = count + LENGTH - 1
            family.add(columns(data, _stretch(np.cumsum(long) - long, count)), np.repeat(docs, count), np.arange(seen, seen + size))
            seen, held, size = seen + size, [], 0
    marked = family.marked()
    rows, at, count = (np.concatenate([p[k] for p in pieces]) for k in (0, 2, 3))
    begin = np.cumsum(count) - count
    bit = np.uint64(1) << (np.arange(total) - np.repeat(begin, count)).astype(np.uint64)
    marks = np.add.reduceat(np.where(marked, bit, np.uint64(0)), begin)
    hit = marks > 0
    return rows[hit], at[hit], marks[hit]


def _scan(table: pa.Table, ranges: int) -> pa.Table:
    """Marks of a receiver's strings that also start in a document with a smaller id, one shard after the other."""
    pieces, out, found = [[] for _ in range(FOLD)], [], []
    held = table.column("bytes")
    for i, x in enumerate(table.drop_columns(["bytes"]).to_pylist()):
        if x["kind"] == "mark":
            out.append((x["part"], x["rows"], x["owner"], x["at"], held[i].as_py()))
            continue
        owner, cuts = unpack(x["owner"], "<u4"), np.cumsum(unpack(x["cuts"], "<u4"), dtype=np.int64)
        rows, docs, at, count = unpack(x["rows"], "<i8")[owner], unpack(x["docs"], "<i8")[owner], unpack(x["at"], "<u4"), unpack(x["count"], "<u1").astype(np.int64)
        data, edge, a = np.frombuffer(held[i].as_buffer(), np.uint8), np.concatenate([[0], np.cumsum(count + LENGTH - 1)]), 0
        for shard, b in zip(pieces, cuts.tolist(), strict=True):
            if a < b:
                shard.append((rows[a:b], docs[a:b], at[a:b], count[a:b], data[edge[a] : edge[b]]))
            a = b
    for shard in pieces:
        if shard:
            found.append(_shard_marks(shard))
        shard.clear()
    if found:
        rows, at, marks = (np.concatenate([f[i] for f in found]) for i in range(3))
        for r, names, spans, (p, m) in _by_range(rows, ranges, at, marks):
            out.append((r, pack(names), pack(spans), pack(p.astype("<u4")), pack(m.astype("<u4"))))
    return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), **{c: pa.array([x[i] for x in out], pa.binary()) for i, c in enumerate(("rows", "spans", "at", "marks"), 1)}})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
    """Each text without the bytes that marked strings cover."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for x in marks.to_pylist():
        ends = np.cumsum(unpack(x["spans"], "<u4"))[:-1]
        for row, at, m in zip(unpack(x["rows"], "<i8").tolist(), np.split(unpack(x["at"], "<u4"), ends), np.split(unpack(x["marks"], "<u4"), ends), strict=True):
            found.setdefault(row, []).append((at, m))
    out: list[tuple] = []
    for row, doc, text in zip(*[texts.column(c).to_pylist() for c in ("row", "doc_id", "text")], strict=True):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.zeros(len(data) + 1, np.int32)
        for at, m in found.get(row, ()):
            run, bit = np.nonzero((m[:, None] >> np.arange(WINDOW, dtype=np.uint32)) & np.uint32(1))
            start = at[run].astype(np.int64) + bit
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, data[~gone].tobytes()))
    kinds = (pa.int64(),) * 4 + (pa.binary(),)
    return pa.table({c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), kinds, strict=True))})


def _named(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` whose ``row`` is among ``rows`` (left_semi) or not (left_anti); a long list is joined by shuffle."""
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", how)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text (doc_id, text) without its repeated bytes."""
    tables = Tables(docs.sparkSession, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges, shards = (max(LEAST_SHARDS, -(-total // (n * SHARD_BYTES))) for n in (RANGE, GRAM_SHARD))
    is_long = F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    long = rows.filter(is_long)
    digest = F.sha2("text", 256)
    equal = long.select("row", "doc_id", digest.alias("digest"))
    least = equal.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    copies = tables.write("copies", equal.join(least, "digest").filter("doc_id > least").select("row").distinct())
    single = _named(long, copies, "left_anti")
    flags = _grams_dealt(single, shards, ranges).groupBy("part").applyInArrow(lambda t: _shared_grams(t, ranges), GRAM_FLAGS)
    flags = tables.write("grams", flags)
    strings = (flags.agg(F.sum("n")).first()[0] or 0) * (WINDOW + 1) // 2  # what a gram is the least of, in the mean
    receivers = max(LEAST_RECEIVERS, -(-strings // (FOLD * SHARD_BYTES)))
    ranged = lambda df: df.withColumn("part", F.pmod("row", F.lit(ranges)).cast("int"))
    runs = ranged(single).groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(lambda a, b: _suffix_runs(a, b, ranges, receivers), RUN_ROWS)
    marks = tables.write("marks", runs.groupBy("part").applyInArrow(lambda t: _scan(t, ranges), MARKS))
    tables.drop("grams")

    def names(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x, "<i8"))], names=["row"])

    touched = tables.write("rows", marks.select("rows").mapInArrow(names, "row long").distinct())
    few = touched.count() <= BROADCAST_ROWS  # else texts are not picked by a join, which would move them all: all are dealt to their marks
    cut = ranged(_named(single, touched, "left_semi") if few else single).groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_cut, RESULT)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = _named(long, copies, "left_semi").select("doc_id", size, size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    same = _named(rows, touched.unionByName(copies), "left_anti") if few else rows.filter(~is_long)
    same = same.select("doc_id", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole).unionByName(same)


