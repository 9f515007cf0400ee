"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line or sentence, cut after 200 characters where none ends. The distinct 64-bit digests of a
text's paragraphs are hashed into three cells each of a sketch; a cell holds a count, the XOR of its digests and
the XOR of their checks. Two sketches subtract cell by cell, and peeling cells that hold a single digest recovers
the digests that only one text has. Where peeling gets stuck both sketches are built again with other hashes and, up to
four cells a digest, four times the cells, until all is recovered. From the recovered differences and the two set sizes follows the likeness, the share of common paragraphs.

Sketches of a block of texts are built and peeled together as matrices.

Defined results: a null text is the empty text, which has no paragraphs; two empty texts have likeness 1, an empty
and another text 0; a paragraph repeated in a text counts once; equal texts have equal fingerprints; an empty
table gives an empty table; columns not named in ``keep`` are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.shared import shuffle_parts
from tenderloom.llm.words import mix, spans

#: Cells of the published sketch; a multiple of three.
CELLS = 24
PARAGRAPH = re.compile(r"[^.!?\n]{0,200}[.!?\n]+|[^.!?\n]{1,200}")
BLOCK_CHARS = 1_000_000


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs."""
    found = {p.strip() for p in PARAGRAPH.findall(text)}
    return np.frombuffer(b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in found if p), "<u8")


def _cells(keys: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Three cells of each key, one in each third."""
    third = np.uint64(cells // 3)
    return np.stack([(mix(mix(keys + np.uint64(seed)) ^ np.uint64(0x51ED27 * (j + 1) + cells)) % third).astype(np.int64) + j * int(third) for j in range(3)])


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0xA5A5A5A5)) & np.uint64(0xFFFFFFFF)


class Sketches:
    """One sketch a row: counts, XOR of digests, XOR of checks."""

    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray, seed: int = 0):
        self.count, self.key, self.check, self.seed = count, key, check, seed

    @classmethod
    def of(cls, sets: Sequence[np.ndarray], cells: int, seed: int = 0) -> Sketches:
        out = cls(np.zeros((len(sets), cells), np.int32), np.zeros((len(sets), cells), np.uint64), np.zeros((len(sets), cells), np.uint64), seed)
        keys = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        out._add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), keys, np.ones(len(keys), np.int32))
        return out

    def _add(self, rows: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        cells = self.count.shape[1]
        flat = (rows * cells + _cells(keys, cells, self.seed)).ravel()
        np.add.at(self.count.reshape(-1), flat, np.tile(sign, 3))
        np.bitwise_xor.at(self.key.reshape(-1), flat, np.tile(keys, 3))
        np.bitwise_xor.at(self.check.reshape(-1), flat, np.tile(_check(keys), 3))

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.count - other.count, self.key ^ other.key, self.check ^ other.check, self.seed)

    def peel(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(rows fully recovered, recovered (row, digest, sign)); sign 1: only in the first text, -1: only in the second."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(4 * self.count.shape[1] + 8):
            rows, at = np.nonzero((np.abs(self.count) == 1) & (self.check == _check(self.key)))
            if not len(rows):
                break
            keys, sign = self.key[rows, at], self.count[rows, at]
            order = np.lexsort((keys, rows))
            rows, keys, sign = rows[order], keys[order], sign[order]
            fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])
            rows, keys, sign = rows[fresh], keys[fresh], sign[fresh]
            self._add(rows, keys, -sign)
            found.append((rows, keys, sign))
        done = ~(self.count.any(axis=1) | self.key.any(axis=1) | self.check.any(axis=1))
        return done, [x for r, k, s in found for x in zip(r.tolist(), k.tolist(), s.tolist(), strict=True)]

    def written(self) -> list[str]:
        """Each sketch as text: 16 bytes a cell."""
        packed = np.concatenate(
            [self.count.astype("<u4")[:, :, None].view(np.uint8), self.key.astype("<u8")[:, :, None].view(np.uint8), self.check.astype("<u4")[:, :, None].view(np.uint8)], axis=2
        )
        return [base64.b64encode(x.tobytes()).decode() for x in packed]


def recover(a: Sequence[np.ndarray], b: Sequence[np.ndarray], cells: int = CELLS) -> list[set[tuple[int, int]]]:
    """For each pair of digest sets the (digest, sign) that one of them lacks."""
    out: list[set[tuple[int, int]]] = [set() for _ in a]
    left, seed = np.arange(len(a)), 0
    while len(left):
        done, found = Sketches.of([a[i] for i in left], cells, seed).minus(Sketches.of([b[i] for i in left], cells, seed)).peel()
        good = set(np.flatnonzero(done).tolist())
        for row, key, sign in found:
            if row in good:
                out[left[row]].add((key, sign))
        left, seed = left[~done], seed + 1
        if cells < 4 * max((len(a[i]) + len(b[i]) for i in left), default=0) + CELLS:
            cells *= 4
    return out


def likeness(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[float]:
    """Common paragraphs as a share of all, from the recovered differences."""
    out = []
    for x, y, only in zip(a, b, recover(a, b), strict=True):
        union = (len(x) + len(y) + len(only)) / 2
        out.append((len(x) + len(y) - len(only)) / 2 / union if union else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(part, halo, key, text): rows dealt by ranges of ``key`` and sorted downwards; each part ends with its successor.

    The ranges end with keys that stand at even shares of all rows, found by a quantile sketch, so that outlying keys
    do not matter. The rows of a range's last key are copied to the end of the range above (of the very last to the
    lowest), marked ``halo``, so that every row's successor follows it in the same part. Only the ends of the ranges
    reach the driver.
    """
    parts = parts or shuffle_parts(docs.sparkSession)
    low = docs.agg(F.min(key)).first()[0] or 0
    at = F.coalesce(F.col(key), F.lit(low - 1))  # null ids come last
    high = docs.agg(F.max(at)).first()[0]
    high = low if high is None else high
    rows = docs.select(at.alias("at"), F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    found = rows.agg(F.percentile_approx("at", shares, 20 * parts)).first()[0] if shares is not None else None
    ends = sorted({*(found or []), high})
    groups = [ends[i : i + 64] for i in range(0, len(ends), 64)]
    text = F.lit(",".join(map(str, ends)))
    fixed = F.split(text, ",").cast("array<bigint>")
    heads = F.split(F.lit(",".join(str(g[-1]) for g in groups)), ",").cast("array<bigint>")
    # The number of ends below a key, first by groups of 64 ends, then within one group.
    group = F.size(F.filter(heads, lambda e: e < F.col("at")))
    some = F.slice(fixed, group * 64 + 1, F.lit(64))
    part = group * 64 + F.size(F.filter(some, lambda e: e < F.col("at")))
    dealt = rows.withColumn("part", part)
    is_end = F.element_at(fixed, F.col("part") + 1) == F.col("at")
    above = F.when(F.col("part") + 1 < len(ends), F.col("part") + 1).otherwise(F.lit(0))
    one = lambda p, halo: F.struct(p.cast("int").alias("part"), F.lit(halo).alias("halo"))
    places = F.when(is_end, F.array(one(F.col("part"), False), one(above, True))).otherwise(F.array(one(F.col("part"), False)))
    out = dealt.withColumn("place", F.explode(places)).select("place.part", "place.halo", "at", "key", "text")
    return out.repartition(parts, "part").sortWithinPartitions("part", "halo", F.desc("at"), "text")


def _rows(batch: pa.RecordBatch):
    """(part, halo, key, text) of each row; texts leave the batch about a megabyte at a time."""
    for first, texts in spans(batch.column("text"), BLOCK_CHARS):
        part = batch.slice(first, len(texts))
        yield from zip(*[part.column(c).to_pylist() for c in ("part", "halo", "key", "text")], strict=True)


OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame) -> DataFrame:
    """A row a document (doc_id, text): its fingerprint, that of its edited text, and the likenesses.

    The next document is the one with the next smaller id; of equal ids the one with the next larger text; after
    the last comes the first. ``edited`` is the edited text itself.
    """

    def block(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[3] for r, _ in rows]
        changed = [edited(r[3], n[3]) for r, n in rows]
        own, other = [digests(t) for t in texts], [digests(t) for t in changed]
        after = [own[i + 1] if i + 1 < len(rows) and rows[i][1] is rows[i + 1][0] else digests(rows[i][1][3]) for i in range(len(rows))]
        columns = [
            pa.array([r[2] for r, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(changed, pa.string()),
            pa.array(Sketches.of(own, CELLS).written(), pa.string()),
            pa.array(Sketches.of(other, CELLS).written(), pa.string()),
            pa.array(likeness(own, other), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        last, rows, size = None, [], 0
        for batch in batches:
            for row in _rows(batch):
                if last is not None and not last[1] and last[0] == row[0]:
                    rows.append((last, row))
                    size += len(last[3])
                    if size >= BLOCK_CHARS:
                        yield block(rows)
                        rows, size = [], 0
                last = row
        if rows:
            yield block(rows)

    return in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, OUT)


