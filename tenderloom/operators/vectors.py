"""Nearest vectors by cosine for many queries at once: exactly, or through an index of cells.

Stored vectors and queries meet in a grid: vectors are dealt into parts of about ``PART`` rows, queries into blocks of
``QUERY_BLOCK``, and each meeting of a part and a block is one group of a task, which multiplies both and sends on its
best only. Nothing of either side passes through the driver, and the plan is the same for any number of queries.

Rows whose vector is null, empty, all zero, or holds a null, NaN or infinity have no direction: they find nothing and are
not found. Vectors meet those of their own length only. Similarities equal to some digits are told apart by key as text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.operators.scratch import Scratch
from tenderloom.operators.state import first_of_each

PART, QUERY_BLOCK = 65_536, 2_000
#: Products of a vector and a query that a task holds at once.
PRODUCTS = 1 << 20
#: Rows on which the centres of an index are fitted, at most.
SAMPLE = 20_000


def directed(v: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(vectors: pa.Table, queries: pa.Table, key: str, by: str | None, most: int, digits: int) -> pa.Table:
    """The ``most`` nearest rows of ``vectors`` to each of ``queries``, or as many of each value of ``by``."""
    labels = [by] if by else []
    names = ["query_id", key, *labels, "similarity"]
    keys = vectors.column(key).combine_chunks()
    v = _matrix(vectors.column("vector")) if len(keys) else np.zeros((0, 1))
    order = np.argsort(np.array([str(k) for k in keys.to_pylist()], object), kind="stable") if len(keys) else np.zeros(0, np.int64)
    groups = vectors.column(by).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if by else np.zeros(len(keys), np.int64)
    found: list[pa.Table] = []
    step = max(1, PRODUCTS // max(1, len(keys)))
    for s in range(0, queries.num_rows if len(keys) else 0, step):
        some = queries.slice(s, step)
        near = _matrix(some.column("vector")) @ v.T
        for group in np.unique(groups):
            mine = order[groups[order] == group]
            take = mine[np.argsort(-np.round(near[:, mine], digits), axis=1, kind="stable")[:, :most]]
            who = pa.array(np.repeat(np.arange(len(some)), take.shape[1]))
            picked = pa.array(take.ravel())
            columns = [some.column("query_id").take(who), keys.take(picked), *[vectors.column(c).take(picked) for c in labels], pa.array(np.take_along_axis(near, take, 1).ravel())]
            found.append(pa.table(dict(zip(names, columns, strict=True))))
    if not found:
        empty = [queries.column("query_id").slice(0, 0), keys.slice(0, 0), *[vectors.column(c).slice(0, 0) for c in labels], pa.array([], pa.float64())]
        return pa.table(dict(zip(names, empty, strict=True)))
    return pa.concat_tables(found)


def _meet(vectors: DataFrame, queries: DataFrame, on: list[str], key: str, by: str | None, most: int, digits: int) -> DataFrame:
    """The best of all groups in which vectors (key, vector, by) and queries (query_id, vector) meet, merged by query."""
    labels = [by] if by else []
    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", *[f"{c} {vectors.schema[c].dataType.simpleString()}" for c in [key, *labels]], "similarity double"]
    parts = vectors.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(lambda a, b: _best(a, b, key, by, most, digits), ", ".join(kinds))
    return first_of_each(parts, ["query_id", *labels], [F.desc(F.round("similarity", digits)), F.asc(F.col(key).cast("string"))], most)


def _sides(vectors: DataFrame, queries: DataFrame, key: str, column: str, by: str | None) -> tuple[DataFrame, DataFrame]:
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    left = vectors.filter(directed(F.col(column))).select(key, double(F.col(column)).alias("vector"), *[by] * bool(by), F.size(column).alias("__size"))
    right = queries.filter(directed(F.col("vector"))).select("query_id", double(F.col("vector")).alias("vector"), F.size("vector").alias("__size"))
    return left, right


def nearest(vectors: DataFrame, queries: DataFrame, key: str, column: str, most: int = 10, by: str | None = None, digits: int = 9) -> DataFrame:
    """(query_id, key, similarity): the ``most`` nearest stored vectors of every query (query_id, vector), exactly.

    With ``by``, that many for each of its values, which is a column of the result.
    """
    left, right = _sides(vectors, queries, key, column, by)
    parts, blocks = max(1, -(-left.count() // PART)), max(1, -(-right.count() // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("__block", each(blocks))
    right = right.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("__part", each(parts))
    return _meet(left, right, ["__size", "__part", "__block"], key, by, most, digits)


def centres(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Directions fitted to unit vectors by spherical k-means; as many as there are different vectors, at most."""
    sample = np.unique(sample, axis=0)
    out = sample[np.random.default_rng(seed).permutation(len(sample))[:n]]
    for _ in range(rounds):
        at = (sample @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, at, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(length > 0, sums / np.maximum(length, 1e-300), out)
    return out


class CellIndex:
    """Stored vectors by the nearest of some centres; a query looks into the cells of its ``probes`` nearest centres only.

    Centres are fitted on a sample of at most ``SAMPLE`` rows; every row is in a cell. What is found is ranked by exact
    similarity; what lies in cells not looked into is missed, so recall is to be measured. Looking into all cells is exact.
    A cell of many rows is split into parts of about ``PART``.
    """

    def __init__(self, vectors: DataFrame, key: str, column: str, cells: int, by: str | None = None):
        left, _ = _sides(vectors, vectors.select(F.col(key).alias("query_id"), F.col(column).alias("vector")), key, column, by)
        self.key, self.by = key, by
        n = left.count()
        sample = left.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(max(1, n // SAMPLE))) == 0).select("vector", "__size").limit(SAMPLE).collect()
        sizes = [r["__size"] for r in sample]
        self.size = max(set(sizes), key=sizes.count) if sizes else 0
        picked = [r["vector"] for r in sample if r["__size"] == self.size]
        self.centres = centres(_matrix(pa.array(picked)), cells) if picked else np.zeros((0, 1))
        self.rows = Scratch(vectors.sparkSession, "cells").write("rows", self._placed(left.filter(F.col("__size") == self.size), 1))
        counts = self.rows.groupBy(F.col("__cell").alias("__of")).agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts"))
        self.parts = F.broadcast(counts)  # one row a centre

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` once for each of the ``probes`` nearest centres, as ``__cell``."""
        middle, names = self.centres, rows.columns
        probes = min(probes, len(middle))
        schema = T.StructType([*rows.schema.fields, T.StructField("__cell", T.IntegerType())])

        def run(batches):
            for batch in batches:
                if not batch.num_rows or not probes:
                    continue
                near = _matrix(batch.column("vector")) @ middle.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), probes)))
                yield pa.RecordBatch.from_arrays([*[again.column(c) for c in names], pa.array(cells.ravel().astype(np.int32))], names=[*names, "__cell"])

        return rows.mapInArrow(run, schema)

    def nearest(self, queries: DataFrame, most: int = 10, probes: int = 8, digits: int = 9) -> DataFrame:
        """(query_id, key, similarity), as ``nearest`` over what the probed cells hold."""
        _, right = _sides(queries, queries, "query_id", "vector", None)
        asked = self._placed(right.filter(F.col("__size") == self.size), probes)
        blocks = max(1, -(-asked.count() // max(1, QUERY_BLOCK * max(1, len(self.centres)))))
        same = F.col("__cell") == F.col("__of")
        left = self.rows.join(self.parts, same).withColumn("__part", F.pmod(F.xxhash64(self.key), F.col("__parts")).cast("int")).drop("__of", "__parts")
        left = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.join(self.parts, same).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__of", "__parts")
        asked = asked.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        return _meet(left, asked, ["__cell", "__part", "__block"], self.key, self.by, most, digits)
