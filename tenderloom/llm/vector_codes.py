"""Short codes for vectors: product quantisation by Yinyang Lloyd in whole numbers.

A vector is cut into equal parts; each part position has a codebook, and a part's code is the index of its nearest
entry. Components are ``floor(SCALE * x)``, so that distances, ties and means are exact whatever the partitioning.

Training is Lloyd's iteration with Yinyang bounds. The entries of a codebook are clustered into groups once, and each
part keeps for each group one lower bound of its distances to the group's entries (its own aside). After an update a
bound falls by the largest drift in its group; only groups whose bound does not exceed the exact distance to the part's
own entry are scanned, with squared distances in 64-bit integers, and the smallest pair of distance and index wins.
Bounds are rounded down, own distances up, so an entry at an equal distance is always looked at.

One pass of tasks a round reads the state (components, codes, bounds: one row a vector) from a table in the shared
folder and writes the next. Sums for the new entries stand beside the first row of each batch and are added up by
partition and then by Spark; the driver sees one row a position and entry, nothing of the vectors.

Rows go whose vector is null or holds a null, NaN or infinity. Shorter vectors count as filled with zeros up to the
longest, whose length is rounded up to a multiple of the parts; an empty vector is a vector of zeros. Fewer kept rows
than entries make a codebook of as many entries; none make no rows. The first entries come from the smallest ids, nulls
last, equal ids by their components. Repeated rows and ids all count. A component beyond the range in which 64 bits
hold the distances (about 3e4 before scaling for 64 components) ends the job with an error. Other columns pass through under their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.shared import Tables, beside_groups

SCALE = 4096
#: Relative slack of a bound against rounding in 64-bit floats.
_SLACK = 1e-6
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (positions, entries, width) whole numbers; ``groups``: the group of each entry, by position."""

    entries: np.ndarray
    groups: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is a vector of finite numbers, with ``__x``: its scaled components, rounded down."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(x.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("__x", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)))


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Each entry's group, by a few rounds of k-means over a codebook's own entries; at most ``groups`` of them."""
    out = np.zeros(entries.shape[:2], np.int64)
    for p, book in enumerate(entries.astype(np.float64)):
        centres = book[:: max(1, len(book) // groups)][:groups]
        for _ in range(rounds):
            out[p] = ((book[:, None] - centres[None]) ** 2).sum(2).argmin(1) if len(book) else 0
            centres = np.array([book[out[p] == g].mean(0) if (out[p] == g).any() else c for g, c in enumerate(centres)])
    return out


def own_distances(x: np.ndarray, book: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((x - book[codes]) ** 2).sum(1)


def assign(x: np.ndarray, book: np.ndarray, groups: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, squared distances, bounds, distances looked at) of one position's parts.

    ``bounds`` holds for each part and group a number below its distance to every entry of the group but its own.
    """
    n, k = len(x), len(book)
    own = own_distances(x, book, codes)
    near = np.sqrt(own) * (1 + _SLACK)
    need = bounds <= near[:, None]
    seen = np.full((n, k), _FAR)
    every = np.arange(n)
    seen[every, codes] = own
    looked = n
    for g in range(bounds.shape[1]):
        rows, members = np.flatnonzero(need[:, g]), np.flatnonzero(groups == g)
        if len(rows) and len(members):
            seen[rows[:, None], members] = ((x[rows, None, :] - book[None, members]) ** 2).sum(2)
            looked += len(rows) * len(members)
    best = seen.argmin(1)  # the first of equal distances
    distance = seen[every, best]
    seen[every, best] = _FAR
    bounds = bounds.copy()
    for g in range(bounds.shape[1]):
        rows, members = np.flatnonzero(need[:, g]), np.flatnonzero(groups == g)
        if len(rows):
            least = seen[rows[:, None], members].min(1) if len(members) else np.full(len(rows), _FAR)
            bounds[rows, g] = np.where(least == _FAR, np.inf, np.sqrt(least.astype(np.float64)) * (1 - _SLACK))
    left = np.flatnonzero(best != codes)  # the entry that a part leaves counts for its group from now on
    at = groups[codes[left]]
    bounds[left, at] = np.minimum(bounds[left, at], np.sqrt(own[left]) * (1 - _SLACK))
    return best, distance, bounds, looked


def drifts(old: np.ndarray, new: np.ndarray, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """(positions, groups): no less than the way of each group's entry that moved farthest."""
    way = np.sqrt(((new - old) ** 2).sum(2)) * (1 + _SLACK)
    out = np.zeros((len(old), n_groups))
    for p in range(len(old)):
        np.maximum.at(out[p], groups[p], way[p])
    return out


@dataclass(frozen=True)
class Layout:
    """What tasks know of the state table: names of the rows' own columns, parts, width of a part, groups."""

    keep: tuple[str, ...]
    parts: int
    width: int
    groups: int

    def names(self) -> list[str]:
        return [*self.keep, "__x", "__codes", "__bounds", "__error", "__sums"]

    def components(self, column: pa.Array) -> np.ndarray:
        """Lists of numbers as a matrix, zeros after the end of a shorter one."""
        x = np.zeros((len(column), self.parts * self.width), "<i4")
        length = np.diff(np.asarray(column.offsets)).astype(np.int64)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        x[np.repeat(np.arange(len(x)), length), place] = column.flatten().to_numpy(zero_copy_only=False)
        return x

    def first(self, batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        """The first assignment: every bound is 0, so that all groups are scanned."""
        for batch in batches:
            n = batch.num_rows
            yield self.step(batch, self.components(batch.column("__x")), np.zeros((n, self.parts), np.uint8), np.zeros((n, self.parts, self.groups), np.float32), books, np.zeros((self.parts, self.groups)))

    def again(self, batches: Iterator[pa.RecordBatch], books: Codebooks, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("__x"), "<i4", self.parts * self.width)
            codes = _matrix(batch.column("__codes"), "u1", self.parts)
            bounds = _matrix(batch.column("__bounds"), "f4", self.parts * self.groups).reshape(-1, self.parts, self.groups)
            yield self.step(batch, x, codes, bounds, books, drift)

    def step(self, batch: pa.RecordBatch, x: np.ndarray, codes: np.ndarray, bounds: np.ndarray, books: Codebooks, drift: np.ndarray) -> pa.RecordBatch:
        """The rows by ``books``; the batch's sums stand beside its first row."""
        n, k = len(x), books.entries.shape[1]
        parts = x.reshape(n, self.parts, self.width).astype(np.int64)
        new_codes, new_bounds, error = np.zeros_like(codes), np.zeros_like(bounds), np.zeros(n, np.int64)
        sums, looked = np.zeros((self.parts, k, self.width + 1), np.int64), 0
        for p in range(self.parts):
            low = bounds[:, p].astype(np.float64) - drift[p]
            code, distance, low, seen = assign(parts[:, p], books.entries[p], books.groups[p], codes[:, p].astype(np.int64), low)
            rounded = low.astype(np.float32)
            new_bounds[:, p] = np.where(rounded > low, np.nextafter(rounded, np.float32(-np.inf)), rounded)
            new_codes[:, p], error, looked = code, error + distance, looked + seen
            mine = (code == np.arange(k)[:, None]).astype(np.int64)
            sums[p, :, 0], sums[p, :, 1:] = mine.sum(1), mine @ parts[:, p]
        packed = np.append(sums.reshape(-1), looked).tobytes()
        made = [_binary(x), _binary(new_codes), _binary(new_bounds), pa.array(error, pa.int64()), pa.array([packed, *[None] * n][:n], pa.binary())]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in self.keep], *made], names=self.names())


def summed(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, int]:
    """(positions, entries, 1 + width): counts and component sums over all rows; and how many distances were worked out.

    What reaches the driver is one number a position, entry and component, whatever the number of rows.
    """
    positions, entries, width = books.entries.shape
    size = positions * entries * (width + 1) + 1

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    rows = state.select("__sums").filter("__sums IS NOT NULL").mapInArrow(run, "at long, value long")
    out = np.zeros(size, object)
    for at, value in rows.groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
        out[at] = int(value)
    return out[:-1].reshape(positions, entries, width + 1), out[-1]


def moved(books: Codebooks, sums: np.ndarray) -> Codebooks:
    """Entries at the floor of their parts' means; unused ones stay."""
    entries = books.entries.copy()
    for p, e in np.ndindex(*entries.shape[:2]):
        if count := sums[p, e, 0]:
            entries[p, e] = [total // count for total in sums[p, e, 1:]]
    return Codebooks(entries, books.groups)


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = 8, entries: int = 16, groups: int = 4, rounds: int = 6) -> tuple[DataFrame, Codebooks, list[int]]:
    """(the kept rows with ``codes``, one byte a part, and ``error``; the codebooks; distances worked out in each round).

    The vector column does not return. ``error`` is the sum of the parts' squared distances to their entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes are one byte")
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "vector-codes")
    rows = whole_vectors(vectors, vector_column).drop(vector_column)
    kept = [f for f in rows.schema.fields if f.name != "__x"]
    out = T.StructType([*kept, T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])
    longest, largest = rows.agg(F.max(F.size("__x")), F.max(F.greatest(F.lit(0), F.array_max("__x"), -1 - F.array_min("__x")))).first()
    if longest is None:
        return spark.createDataFrame([], out), Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0), np.int64)), []
    width = -(-longest // parts)
    if 4 * (largest + 1) ** 2 * max(1, width) * parts >= 1 << 62:
        raise ValueError(f"scaled components up to {largest} are too large for squared distances of 64 bits")
    layout = Layout(tuple(f.name for f in kept), parts, width, groups)
    order = [F.col(id_column).asc_nulls_last(), F.col("__x")]
    smallest = [r["__x"] for r in rows.select(id_column, "__x").orderBy(*order).limit(entries).collect()]
    first = np.zeros((len(smallest), parts * width), np.int64)
    for i, x in enumerate(smallest):
        first[i, : len(x)] = x
    first = first.reshape(len(smallest), parts, width).transpose(1, 0, 2).copy()
    books, looked = Codebooks(first, grouped(first, groups)), []
    binary = [T.StructField(c, T.LongType() if c == "__error" else T.BinaryType()) for c in layout.names()[len(kept) :]]
    schema = T.StructType([*kept, *binary])
    state = tables.write("state0", rows.mapInArrow(lambda b, books=books: layout.first(b, books), schema))
    for i in range(rounds):
        sums, seen = summed(state, books)
        looked.append(int(seen))
        new = moved(books, sums)
        drift = drifts(books.entries, new.entries, books.groups, groups)
        books = new
        state = tables.write(f"state{i + 1}", state.mapInArrow(lambda b, books=books, drift=drift: layout.again(b, books, drift), schema))
        tables.drop(f"state{i}")
    return state.select(*layout.keep, F.col("__codes").alias("codes"), F.col("__error").alias("error")), books, looked


def with_group_sums(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all rows of the same ``group``, nulls together.

    Sums are made by partial aggregation and joined back, so that a common group stays spread.
    """
    return beside_groups(rows, rows.groupBy(group).agg(F.sum(value).alias(out), F.count("*").alias("__n")), group).drop("__n")


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of one length as a matrix, from the column's own memory."""
    n = len(column)
    if not n * width:
        return np.zeros((n, width), kind)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(n, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix as binary values, one a row."""
    data = np.ascontiguousarray(rows)
    each = data.nbytes // len(rows) if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * each).astype(np.int32)), pa.py_buffer(data.tobytes())])
