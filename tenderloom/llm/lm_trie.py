"""Language-model scoring with Elias-Fano n-gram tries.

Tokens are words (A-Z lower-cased, parted by blanks) and one end mark a text; before a text's first token stand two
start marks. The model is an interpolated trigram model with a fixed prior weight for each order,

    p(w | u v) = (c(u v w) + PRIOR3 p(w | v)) / (c(u v) + PRIOR3)
    p(w | v)   = (c(v w) + PRIOR2 p(w)) / (c(v) + PRIOR2),    p(w) = (c(w) + 1) / (N + V + 1).

1. Words: each block of texts asks for the counts of its distinct words, dealt by hash; the parts that own the words
   answer with counts and with small ids, frequent words first. A block then knows every c(w), and scores on its own
   what no n-gram of the training texts can change: tokens that are, or follow, a word unseen in training.
2. N-grams: all others are dealt by the word before the last. So one part holds every count that the score of a token
   needs but c(u v), which stands where u v itself is scored as a pair: its logarithm is added there. N-grams after a
   word of more than ``FREQUENT`` occurrences are dealt by their last word too, so that no part holds all of
   a very common word. This decides where n-grams are dealt, not what they score.
3. A part is a trie: words, below each the words that follow it, below each pair the words before it. A level is one
   Elias-Fano coded sequence of ids, made rising by adding what came before, with Elias-Fano coded pointers into it;
   the smoothed logarithms are quantised to 65,536 levels. All levels lie in one memory map and are never decoded: a
   query takes the range of its parent from the pointers by select, and finds its word by successor search in that
   range, over the coded high and low bits.
4. Sums of each part go back to the blocks, packed.

Defined results: a null text is the empty text, one end mark; a text's copies score alike; every row is scored for
itself, whatever its id; an empty table gives an empty table; with no training text every word is unseen, p is
1 / (V + 1) = 1 and all scores are 0. Blocks are read twice; rows that come in another order the second time are an
error, never a wrong score.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.packing import items, pack, pack_rising, slices, unpack, unpack_rising
from tenderloom.llm.shared import Tables
from tenderloom.llm.words import NOT_BLANK, blocks, in_text, mix, tokenise

#: N-grams after a word of more occurrences are dealt by their last word too: a small share of a part's n-grams, whatever the corpus.
FREQUENT = 2_000
#: Weights of p(w) among pairs and of p(w | v) among triples, whatever the size of the corpus.
PRIOR2, PRIOR3 = 400.0, 12.0
LEVELS = 1 << 16
#: Bytes of text whose n-grams are packed together, and bytes of text for one part of words and of n-grams.
BLOCK, WORD_BYTES, GRAM_BYTES = 4_000_000, 32_000_000, 5_000_000
LEAST_PARTS = 16
END = np.uint64(0xE4D)
#: Ids of words unseen in training, of the start and of the end; those of other words follow.
UNSEEN, START, STOP, FIRST = 0, 1, 2, 3

_BYTE_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _BYTE_SELECT[_b, : len(_at)] = _at


def _select_in(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one with ``rank`` ones before it in each 64-bit word."""
    parts = words.view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
    byte = (upto <= rank[:, None]).sum(axis=1)
    every = np.arange(len(words))
    before = np.where(byte > 0, upto[every, byte - 1], 0)
    return byte * 8 + _BYTE_SELECT[parts[every, byte], rank - before]


class EliasFano:
    """A rising sequence of ``n`` numbers: low bits side by side, high bits in unary; read without decoding it."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.high, self.ones = n, low_bits, high, ones
        self.low = low
        self._low64 = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # eight bytes from any byte on
        self._mask = np.uint64((1 << low_bits) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        if bits > 56:
            raise ValueError("too sparse a sequence")
        shifts = np.arange(bits, dtype=np.uint64)
        low = [np.packbits(((values[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, 65536)]
        high = np.zeros(-(-((top >> bits) + n + 2) // 64) * 64, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(high, bitorder="little").view("<u8")
        return cls(n, bits, np.concatenate([*low, np.zeros(8, np.uint8)]), words, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.ones

    def _one(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right")
        return word * 64 + _select_in(self.high[word], i - np.where(word > 0, self.ones[word - 1], 0))

    def _zero(self, i: np.ndarray) -> np.ndarray:
        zeros = np.arange(64, 64 * len(self.ones) + 64, 64) - self.ones
        word = np.searchsorted(zeros, i, side="right")
        return word * 64 + _select_in(~self.high[word], i - np.where(word > 0, zeros[word - 1], 0))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return (self._low64[at >> 3] >> (at & 7).astype(np.uint64)) & self._mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        return ((self._one(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def successor(self, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found): where the first number not below ``want`` stands among places ``low`` up to ``high``."""
        top = (want >> np.uint64(self.low_bits)).astype(np.int64)
        rest = want & self._mask
        last = len(self.ones) * 64 - self.n - 1  # zeros in all, less one
        inside = top <= last
        ends = np.full(len(want), self.n, np.int64)
        ends[inside] = self._zero(top[inside]) - top[inside]
        begins = np.where(inside, 0, self.n)
        some = inside & (top > 0)
        begins[some] = self._zero(top[some] - 1) - (top[some] - 1)
        a, b = np.clip(begins, low, high), np.clip(ends, low, high)
        stop = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._lows(middle) < rest[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        found = a < stop
        found[found] = self._lows(a[found]) == rest[found]
        return a, found


class Quantised:
    """Numbers as one of LEVELS even steps between their least and largest."""

    def __init__(self, values: np.ndarray):
        self.least = float(values.min()) if len(values) else 0.0
        self.step = (float(values.max()) - self.least) / (LEVELS - 1) if len(values) else 0.0
        self.codes = np.rint((values - self.least) / (self.step or 1.0)).astype(np.uint16)

    def read(self, at: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[at]


def _mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays side by side in one memory map."""
    starts = np.concatenate([[0], np.cumsum([-(-a.nbytes // 8) * 8 for a in arrays])]).tolist()
    memory = mmap.mmap(-1, max(starts[-1], 8))
    out = []
    for a, s in zip(arrays, starts, strict=False):
        memory[s : s + a.nbytes] = a.tobytes()
        out.append(np.frombuffer(memory, a.dtype, len(a), s))
    return out


class Level:
    """Children of the nodes of the level above, in one sequence: pointers into it, and ids that rise below each parent."""

    def __init__(self, parent: np.ndarray, child: np.ndarray, parents: int):
        """``parent`` rising from 0; ``child`` rising for each parent."""
        pointers = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))])
        lasts = np.where(pointers[1:] > pointers[:-1], child[np.maximum(pointers[1:] - 1, 0)], 0) if len(child) else np.zeros(parents, np.uint64)
        before = np.concatenate([[0], np.cumsum(lasts, dtype=np.uint64)])[:-1].astype(np.uint64)
        self.pointers, self.ids = EliasFano.of(pointers.astype(np.uint64)), EliasFano.of(child.astype(np.uint64) + before[parent])

    def find(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each child below its parent; parents below 0 have none."""
        place, found = np.zeros(len(parent), np.int64), np.zeros(len(parent), bool)
        real = np.flatnonzero(parent >= 0)
        if not self.ids.n or not len(real):
            return place, found
        some, back = np.unique(parent[real], return_inverse=True)
        low, high = (self.pointers.get(some + i).astype(np.int64) for i in (0, 1))
        before = np.zeros(len(some), np.uint64)
        before[low > 0] = self.ids.get(low[low > 0] - 1)
        place[real], found[real] = self.ids.successor(low[back], high[back], child[real].astype(np.uint64) + before[back])
        return place, found


class Trie:
    """One part's n-grams: roots (ids), the words after each, the words before each such pair, and their logarithms."""

    def __init__(self, roots: np.ndarray, root: np.ndarray, after: np.ndarray, pair: np.ndarray, before: np.ndarray, logs: list[np.ndarray]):
        """``root`` (place in ``roots``) and ``after`` of each pair, ``pair`` and ``before`` of each triple, in rising order.

        ``logs``: of each pair as a token and as a context, and of each triple.
        """
        self.roots = Level(np.zeros(len(roots), np.int64), roots, 1)
        self.pairs, self.triples = Level(root, after, len(roots)), Level(pair, before, len(root))
        self.logs = [Quantised(x) for x in logs]
        coded = [e for level in (self.roots, self.pairs, self.triples) for e in (level.pointers, level.ids)]
        views = _mapped([*[p for e in coded for p in e.parts()], *[q.codes for q in self.logs]])
        for i, e in enumerate(coded):
            e.__init__(e.n, e.low_bits, *views[3 * i : 3 * i + 3])
        for q, codes in zip(self.logs, views[3 * len(coded) :], strict=True):
            q.codes = codes

    def find(self, root: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pair and of the triple of each query, -1 where there is none."""
        node, found = self.roots.find(np.zeros(len(root), np.int64), root)
        node, found = self.pairs.find(np.where(found, node, -1), after)
        pair = np.where(found, node, -1)
        node, found = self.triples.find(pair, before)
        return pair, np.where(found, node, -1)


def _tokens(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, text number, whether it is its text's first) of every token with its end marks."""
    tokens, _, owner, _ = tokenise(part, NOT_BLANK)
    n = len(part)
    ends = in_text(owner, n)[1:] + np.arange(n)
    word = np.full(len(tokens) + n, END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner] = tokens
    who = np.empty(len(word), np.int64)
    who[inner], who[ends] = owner, np.arange(n)
    first = np.zeros(len(word), bool)
    first[np.concatenate([[0], ends[:-1] + 1])] = True
    return word, who, first


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """A range of hashes for each part, so that rising words have rising parts."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _numbered(batches):
    """(number, rows, first row, texts) of every block of texts of this task, gathered over small batches."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def drain():
        nonlocal number
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for first, texts in blocks(rows.column("text"), BLOCK):
            yield number, rows, first, texts
            number += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= BLOCK or sum(b.num_rows for b in held) >= 4096:
            yield from drain()
            held, size = [], 0
    if held:
        yield from drain()


ASKED = "part int, block long, words binary, counts binary, texts long"
ANSWERED = "part int, block long, ids binary, counts binary, check long, n long, v long, texts long"


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _ask(docs: DataFrame, parts: int) -> DataFrame:
    """The distinct words of every block, dealt by hash, with their occurrences in training texts."""

    def run(batches):
        for number, batch, first, texts in _numbered(batches):
            train = batch.column("train").slice(first, len(texts)).to_numpy(zero_copy_only=False)
            word, who, _ = _tokens(texts)
            names, at = np.unique(word, return_inverse=True)
            counts = np.bincount(at, weights=train[who], minlength=len(names)).astype("<u4")
            out, learnt = [], int(train.sum())
            for p, a, b in zip(*slices(_part_of(names, parts)), strict=True):
                out.append((int(p), number, pack_rising(names[a:b]), pack(counts[a:b]), learnt))
                learnt = 0
            yield _batch(out, ASKED)

    return docs.select("train", "text").mapInArrow(run, ASKED)


def _checked(names: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(names)).view(np.int64)) if len(names) else 0


def _answer(asked: pa.Table, parts: int) -> pa.Table:
    """The ids and counts of the words of one part, for each block that asked."""
    rows = asked.to_pylist()
    words = [unpack_rising(r["words"], "<u8") for r in rows]
    names, at = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([unpack(r["counts"], "<u4") for r in rows]), minlength=len(names)).astype(np.int64)
    ids = np.empty(len(names), np.uint64)
    ids[np.lexsort((names, -counts))] = FIRST + np.arange(len(names), dtype=np.uint64) * np.uint64(parts) + np.uint64(rows[0]["part"])
    ids[names == END] = STOP
    ids[counts == 0] = UNSEEN
    out, begin = [], 0
    totals = (int(counts.sum()), int((counts > 0).sum()))
    for r, w in zip(rows, words, strict=True):
        mine = at[begin : begin + len(w)]
        begin += len(w)
        out.append((r["part"], r["block"], pack(ids[mine]), pack(counts[mine].astype("<u8")), _checked(w), *totals, r["texts"]))
        totals = (0, 0)
    return pa.Table.from_batches([_batch(out, ANSWERED)])


BLOCKS = "block long, words binary, at binary, sizes binary, train binary, ids binary, known binary"
DEALT = "part int, block long, ids binary, counts binary, v binary, w binary, u binary, texts binary, times binary, train binary, named binary, home binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Every block as its distinct words, the tokens as places in them, and what is said of its texts."""

    def run(batches):
        for number, batch, first, texts in _numbered(batches):
            train, known = (batch.column(c).slice(first, len(texts)).to_numpy(zero_copy_only=False) for c in ("train", "named"))
            word, who, _ = _tokens(texts)
            names, at = np.unique(word, return_inverse=True)
            ids = batch.column("doc_id").slice(first, len(texts)).fill_null(0).to_numpy()
            flags = [np.packbits(x.astype(np.uint8)).tobytes() for x in (train, known)]
            yield _batch([(number, pack_rising(names), pack(at.astype("<u4")), pack(np.bincount(who, minlength=len(texts)).astype("<u4")), flags[0], pack(ids), flags[1])], BLOCKS)

    return docs.select("doc_id", "named", "train", "text").mapInArrow(run, BLOCKS)


def _deal(batches, n: int, v: int, starts: int, parts: int):
    """Score what the block can score alone, and deal its other n-grams."""
    for batch in batches:
        for r in batch.to_pylist():
            names, known = unpack_rising(r["words"], "<u8"), sorted(r["answers"], key=lambda x: x["part"])
            cuts = np.cumsum([0, *[items(x["counts"]) for x in known]])
            if cuts[-1] != len(names) or any(_checked(names[a:b]) != x["check"] for a, b, x in zip(cuts[:-1], cuts[1:], known, strict=True)):
                raise RuntimeError("the rows came in another order than before: they are not repeatable")
            ids, counts = (np.concatenate([unpack(x[c], "<u8") for x in known]) for c in ("ids", "counts"))
            at, sizes = unpack(r["at"], "<u4"), unpack(r["sizes"], "<u4").astype(np.int64)
            who, first = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            w, cw = ids[at], counts[at].astype(float)
            before, cv, two = np.empty_like(w), np.empty_like(cw), np.empty_like(w)
            before[1:], cv[1:] = w[:-1], cw[:-1]
            before[first], cv[first] = START, starts
            two[1:] = before[:-1]
            two[first] = START
            p = (cw + 1) / (n + v + 1)
            alone = (cw == 0) | (cv == 0)
            own = np.where(alone, np.log10(PRIOR3 * PRIOR2 * p / (cv + PRIOR2)), 0.0)
            own[alone & (at != np.searchsorted(names, END))] -= np.log10(PRIOR3)
            per_text = lambda x: np.bincount(who, weights=x, minlength=len(sizes))  # noqa: B023, E731
            home = pack(np.concatenate([per_text(own) - np.log10(starts + PRIOR3), per_text(np.log10(p)), per_text(cw > 0), sizes, unpack(r["ids"], "<i8").view(np.float64)]).astype("<f8"))
            w, u, x, cw, cv, who = (a[~alone] for a in (w, two, before, cw, cv, who))
            part = mix(np.where(cv > FREQUENT, x ^ mix(w), x) + np.uint64(1)) % np.uint64(parts)
            order = np.lexsort((who, u, w, x, part))
            part, x, w, u, cw, cv, who = (a[order] for a in (part, x, w, u, cw, cv, who))
            fresh = np.ones(len(part), bool)
            fresh[1:] = (part[1:] != part[:-1]) | (x[1:] != x[:-1]) | (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (who[1:] != who[:-1])
            times = np.diff(np.append(np.flatnonzero(fresh), len(fresh)))
            part, x, w, u, cw, cv, who = (a[fresh] for a in (part, x, w, u, cw, cv, who))
            out, once = [], (r["known"], home)
            for q, a, b in zip(*slices(part), strict=True):
                some, place, back = np.unique(np.concatenate([x[a:b], w[a:b]]), return_index=True, return_inverse=True)
                count = np.concatenate([cv[a:b], cw[a:b]])[place]
                m = b - a
                out.append((int(q), r["block"], pack_rising(some), pack(count.astype("<u8")), pack(back[:m].astype("<u4")), pack(back[m:].astype("<u4")), pack(u[a:b]), pack(who[a:b].astype("<u2")), pack(times[a:b].astype("<u4")), r["train"], *once))
                once = (b"", b"")
            yield _batch(out or [(r["block"] % parts, r["block"], *[b""] * 7, r["train"], *once)], DEALT)


SUMS = "block long, texts binary, score binary, train binary, named binary, home binary"


def _shard(packed: pa.Table, total: int, distinct: int) -> pa.Table:
    """Learn the trie of one part from its training n-grams, then look all of its n-grams up and sum them by text."""
    rows = packed.to_pylist()
    every = [unpack_rising(r["ids"], "<u8") for r in rows]
    ids, one = np.unique(np.concatenate(every), return_index=True)
    count = np.concatenate([unpack(r["counts"], "<u8") for r in rows])[one].astype(float)
    size = [items(r["texts"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), size)
    v, w = (np.concatenate([np.searchsorted(ids, names)[unpack(r[c], "<u4")] for r, names in zip(rows, every, strict=True)]).astype(np.int64) for c in "vw")
    u = np.concatenate([unpack(r["u"], "<u8") for r in rows])
    who, times = np.concatenate([unpack(r["texts"], "<u2") for r in rows]), np.concatenate([unpack(r["times"], "<u4") for r in rows]).astype(np.int64)
    train = np.concatenate([np.unpackbits(np.frombuffer(r["train"], np.uint8)).astype(bool)[unpack(r["texts"], "<u2")] for r in rows])
    del every
    both = v << np.int64(32) | w
    order = np.lexsort((u, both))
    if not len(order):
        return pa.Table.from_batches([_batch([(r["block"], b"", b"", r["train"], r["named"], r["home"]) for r in rows], SUMS)])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (both[order][1:] != both[order][:-1]) | (u[order][1:] != u[order][:-1])
    head = np.flatnonzero(fresh)
    gram = np.empty(len(order), np.int64)
    gram[order] = np.cumsum(fresh) - 1
    seen = np.add.reduceat(np.where(train, times, 0)[order], head)
    v, w, u, both = v[order[head]], w[order[head]], u[order[head]], both[order[head]]
    p = (count + 1) / (total + distinct + 1)
    trie = _trained(ids, count, p, both[seen > 0], u[seen > 0], seen[seen > 0].astype(float))
    pair, triple = trie.find(ids[v], ids[w], u)
    logs = np.log10(PRIOR3 * PRIOR2 * p[w] / (count[v] + PRIOR2))
    context = np.full(len(pair), -np.log10(PRIOR3))
    logs[pair >= 0], context[pair >= 0] = trie.logs[0].read(pair[pair >= 0]), trie.logs[1].read(pair[pair >= 0])
    logs[triple >= 0] = trie.logs[2].read(triple[triple >= 0])
    logs += np.where(ids[w] == STOP, 0.0, context)
    value, out, begin = logs[gram] * times, [], 0
    for r, n in zip(rows, size, strict=True):
        mine, score = who[begin : begin + n], value[begin : begin + n]
        texts = np.flatnonzero(np.bincount(mine))
        out.append((r["block"], pack_rising(texts.astype("<u2")), pack(np.bincount(mine, weights=score)[texts].astype("<f4")), r["train"], r["named"], r["home"]))
        begin += n
    return pa.Table.from_batches([_batch(out, SUMS)])


def _trained(ids: np.ndarray, count: np.ndarray, p: np.ndarray, both: np.ndarray, u: np.ndarray, seen: np.ndarray) -> Trie:
    """The trie of training triples: pairs (places of both words in ``ids``), the word before, and occurrences."""
    pairs, begin, _ = slices(both)
    v, w = pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF)
    pair_n = np.add.reduceat(seen, begin) if len(begin) else np.zeros(0)
    roots, root = np.unique(v, return_inverse=True)
    pair = np.repeat(np.arange(len(pairs)), np.diff(np.append(begin, len(both))))
    smooth = PRIOR3 * (pair_n + PRIOR2 * p[w]) / (count[v] + PRIOR2)
    return Trie(ids[roots], root, ids[w], pair, u, [np.log10(smooth), -np.log10(pair_n + PRIOR3), np.log10(seen + smooth[pair])])


SCORED = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"


def _merged(sums: pa.Table) -> pa.Table:
    """The texts of one block, with the sums of all parts."""
    rows = sums.to_pylist()
    head = next(r for r in rows if r["home"])
    own, base, known, sizes, ids = unpack(head["home"], "<f8").reshape(5, -1)
    named, trained = (np.unpackbits(np.frombuffer(head[c], np.uint8))[: len(own)].astype(bool) for c in ("named", "train"))
    score = own.copy()
    for r in rows:
        score[unpack_rising(r["texts"], "<u2").astype(np.int64)] += unpack(r["score"], "<f4")
    return pa.table(
        {
            "doc_id": pa.array(np.ascontiguousarray(ids).view(np.int64), mask=~named),
            "trained": trained,
            "n_tokens": sizes.astype(np.int64),
            "n_known": known.astype(np.int64),
            "base_score": base,
            "score": score,
        }
    )


def score(docs: DataFrame, train: Column, repeatable: bool = False) -> DataFrame:
    """A row a document (doc_id, text): trained, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``train`` holds and scores all. ``repeatable``: ``docs`` is a plain scan of
    files, whose rows come in the same order each time; any other input is written first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    tables = Tables(docs.sparkSession, "lm")
    if not repeatable:
        rows = tables.write("rows", rows)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    word_parts, parts = (max(LEAST_PARTS, -(-size // each)) for each in (WORD_BYTES, GRAM_BYTES))
    words = tables.write("words", _ask(rows, word_parts).groupBy("part").applyInArrow(lambda t: _answer(t, word_parts), ANSWERED), 32)
    n, v, starts = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "texts")]).first()
    answers = words.groupBy("block").agg(F.collect_list(F.struct("part", "ids", "counts", "check")).alias("answers"))
    dealt = _blocks(rows).join(answers, "block").mapInArrow(lambda batches: _deal(batches, n, v, starts, parts), DEALT)
    sums = dealt.groupBy("part").applyInArrow(lambda t: _shard(t, n, v), SUMS)
    scored = tables.write("scores", sums.groupBy("block").applyInArrow(_merged, SCORED), 32)
    tables.drop("words", "rows")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
