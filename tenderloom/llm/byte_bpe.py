"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Each match of the split pattern is encoded on its own. Distinct pieces of a block of texts are put into padded
matrices by length; in each round every row merges its leftmost pair of least rank (pair ranks come from an
open-addressing hash table), rows without a pair leave, and the matrix is compacted. A piece longer than the
widest matrix takes the same merges from a heap, in ``n log n``.

The ranks are a vocabulary file of fixed size, read once on the driver and broadcast. Texts are handled in blocks
of about a megabyte, so a task holds one block and a cache of pieces bounded in bytes whatever its partition's size.
Ids are decoded in the same pass where that is asked for, so that one worker and one vocabulary do both.

Defined results: null texts count as empty and give no ids; a long text is split like any other; equal texts give
equal ids; an empty table gives an empty table; columns not named in ``keep`` are dropped.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.words import spans

WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256, 512)
NONE = np.int32(2**31 - 1)
#: Bytes of pieces and ids, with what Python adds to each, that a worker keeps for later blocks.
CACHE_BYTES = 24_000_000
ENTRY_BYTES = 200
BLOCK = 1_000_000


class Vocabulary:
    """Ranks by bytes, with the pair table and the byte table that encoding and decoding look up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.probes = 0
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """From a file of lines ``base64(token) rank``."""
        return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)})

    def _pairs(self) -> None:
        """The pair table, built when first needed: decoding does without."""
        known = self.ranks
        pairs = [(known[t[:i]], known[t[i:]], r) for t, r in known.items() for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
        self._hash(np.array([a << 32 | b for a, b, _ in pairs], np.uint64), np.array([r for _, _, r in pairs], np.int32))

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            _, one = np.unique(at[left], return_index=True)
            took = np.zeros(len(left), bool)
            took[one] = True
            took &= free
            self.keys[at[left[took]]] = keys[left[took]]
            self.values[at[left[took]]] = ranks[left[took]]
            left = left[~took]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or NONE; ids below 0 pair with nothing."""
        if not self.probes:
            self._pairs()
        shape, key = left.shape, ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)).ravel()
        key[((left < 0) | (right < 0)).ravel()] = np.uint64(2**64 - 2)
        at, out, open_ = self._slot(key), np.full(key.shape, NONE, np.int32), np.arange(len(key))
        for _ in range(self.probes):
            here = self.keys[at[open_]]
            same = here == key[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (here != np.uint64(2**64 - 1))]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces no longer than ``width``."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        flat = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width)[None, :] < sizes[:, None]] = flat
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * n
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                count = (ids[done] >= 0).sum(axis=1)
                for row, line, k in zip(rows[done], ids[done], count, strict=True):
                    out[row] = line[:k].tobytes()
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = best
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            right = np.where(at + 1 < width, ids[every, np.minimum(at + 1, width - 1)], -1)
            ranks[every, at] = self.pair_ranks(ids[every, at], right)
            inner = at > 0
            ranks[every[inner], at[inner] - 1] = self.pair_ranks(ids[every[inner], at[inner] - 1], ids[every[inner], at[inner]])
        return out

    def _long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, from a heap of (rank, position) over linked parts."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i, j: self.ranks.get(self.token(ids[i]) + self.token(ids[j])) if j < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := pair(left, right)) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def token(self, rank: int) -> bytes:
        return self.bytes[self.starts[rank] : self.starts[rank] + self.lengths[rank]].tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode ``pieces`` into the cache."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for text in pieces:
            data = text.encode()
            if len(data) == 1:
                self.cache[text] = self.first[data[0]].tobytes()
            elif len(data) > WIDTHS[-1]:
                self.cache[text] = self._long(data)
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(data)), []).append((text, data))
        for width, group in by_width.items():
            step = max(1, 1_000_000 // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.cache.update(zip((t for t, _ in part), self._matrix([d for _, d in part], width), strict=True))

    def encode_block(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces."""
        fresh: set[str] = set()
        for p in pieces:
            fresh.update(p)
        fresh.difference_update(self.cache)
        self.learn(fresh)
        get = self.cache.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        self.cached += sum(len(x) + len(get(x)) + ENTRY_BYTES for x in fresh)
        if self.cached > CACHE_BYTES:
            self.forget()
        return out

    def forget(self) -> None:
        self.cache.clear()
        self.cached = 0

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids (little-endian, 32 bits)."""
        at = np.frombuffer(ids, "<u4")
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)].tobytes()


_held: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary a worker process."""
    if shared.id not in _held:
        _held.clear()
        _held[shared.id] = Vocabulary.parse(shared.value)
    return _held[shared.id]


class _Shared:
    """A broadcast with a name that workers can keep what they build from it by."""

    def __init__(self, spark, data: bytes):
        self._broadcast, self.id = spark.sparkContext.broadcast(data), hash(data)

    @property
    def value(self) -> bytes:
        return self._broadcast.value


def _pieces(find, text: str) -> Iterator[list[str]]:
    """The matches of a text, some at a time."""
    part: list[str] = []
    for m in find.finditer(text):
        part.append(m.group())
        if len(part) == 200_000:
            yield part
            part = []
    yield part


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, keep: Sequence[str] = ("doc_id",), proof: bool = False) -> DataFrame:
    """``keep`` columns with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens``.

    With ``proof`` the ids are decoded again where they are made, and their bytes are the column ``decoded``.
    """
    shared = _Shared(docs.sparkSession, vocabulary)
    types = [docs.schema[c] for c in keep]
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.BinaryType())] * proof]

    def run(batches):
        vocab, find = _vocabulary(shared), regex.compile(pattern)
        for batch in batches:
            for a, texts in spans(batch.column("__text"), BLOCK):
                texts = texts.to_pylist()
                if len(texts) == 1 and len(texts[0] or "") > 4 * BLOCK:
                    coded = [b"".join(vocab.encode_block([p])[0] for p in _pieces(find, texts[0]))]
                else:
                    coded = vocab.encode_block([find.findall(t) if t else [] for t in texts])
                made = [pa.array(coded, pa.binary()), pa.array([len(x) // 4 for x in coded], pa.int64())]
                if proof:
                    made.append(pa.array([vocab.decode(x) for x in coded], pa.binary()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, len(texts)) for c in keep], *made], names=[*keep, *[f.name for f in added]])
        vocab.forget()  # the worker process outlives the task

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, T.StructType([*types, *added]))


def decode(coded: DataFrame, vocabulary: bytes, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``decoded``, the bytes that ``ids`` stand for; null ids give no bytes."""
    shared = _Shared(coded.sparkSession, vocabulary)
    schema = T.StructType([*[coded.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        vocab = _vocabulary(shared)
        for batch in batches:
            for a, ids in spans(batch.column("__ids"), 4 * BLOCK):
                out = [vocab.decode(x or b"") for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, len(out)) for c in keep], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return coded.select(*keep, F.col("ids").alias("__ids")).mapInArrow(run, schema)
