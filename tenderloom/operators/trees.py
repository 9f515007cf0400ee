"""Listwise ranking by boosted oblivious trees: training by distributed histograms, scoring, exact Shapley values.

An oblivious tree asks the same question at every node of a level, so a row's leaf is a number whose bits are the
answers, and a whole model is two small arrays. Training bins every feature once. A level of a tree is one job: tasks
turn their groups into gradients, sum them by leaf, feature and bin, and Spark adds the tasks' sums up; the driver sees
histograms only, whose size follows the model. Gradients are summed as whole numbers, so that every run and every
partitioning grows the same trees.

A group is the list of one query's candidates (a pool of a few hundred) and is one row while the model is trained. Rows
without a group are left out. Null features count as NaN, and NaN lies below every border.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Gradients and losses are summed in units of this size.
UNIT = 2.0**-24
#: Trees after which scores are written with the rows; later ones are worked out anew in each pass.
KEEP_EVERY = 8


@dataclass(frozen=True)
class Trees:
    """``split_feature``, ``split_border``: (trees, depth); ``leaves``: (trees, 2**depth); ``cover``: training rows of each leaf.

    Bit k of a leaf's number tells whether the row's value is above the border of level k.
    """

    features: tuple[str, ...]
    split_feature: np.ndarray
    split_border: np.ndarray
    leaves: np.ndarray
    cover: np.ndarray
    losses: tuple[tuple[float, float], ...] = field(default=())

    def leaf_numbers(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree; ``x`` is (rows, features)."""
        n, (trees, depth) = len(x), self.split_feature.shape
        out = np.zeros((n, trees), np.int64)
        for k in range(depth):
            out |= (x[:, self.split_feature[:, k]] > self.split_border[:, k]).astype(np.int64) << k
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.leaf_numbers(x)
        return self.leaves[np.arange(self.leaves.shape[0]), at].sum(1)

    def first(self, trees: int) -> Trees:
        return Trees(self.features, self.split_feature[:trees], self.split_border[:trees], self.leaves[:trees], self.cover[:trees], self.losses)

    def bias(self) -> float:
        """The mean score of the training rows: what no feature explains."""
        return float(sum(_expected(self.cover[t], self.leaves[t])[0] for t in range(len(self.leaves))))

    def shares(self) -> np.ndarray:
        """(trees, leaves, features): exact Shapley values of every leaf's value.

        In an oblivious tree a row's contributions depend on its leaf alone, so they are worked out once a leaf. A set of
        known features fixes the levels that ask them; at other levels the row goes both ways, weighted by cover.
        """
        trees, depth = self.split_feature.shape
        out = np.zeros((trees, 1 << depth, len(self.features)))
        for t in range(trees):
            names = sorted(set(self.split_feature[t].tolist()))
            m = len(names)
            value = []
            for known in range(1 << m):
                fixed = [bool(known >> names.index(f) & 1) for f in self.split_feature[t]]
                value.append(_given(self.cover[t], self.leaves[t], fixed))
            for i, f in enumerate(names):
                for known in range(1 << m):
                    if not known >> i & 1:
                        size = known.bit_count()
                        weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                        out[t, :, f] += weight * (value[known | 1 << i] - value[known])
        return out


def _ways(cover: np.ndarray, level: int) -> np.ndarray:
    """(leaves): how much of a node of ``level`` goes the leaf's way there; half where no training row came."""
    n = len(cover)
    low = np.arange(n) & ((1 << level) - 1)
    node = np.bincount(low, cover, n)[low]
    mine = np.bincount(np.arange(n) & ((2 << level) - 1), cover, n)[np.arange(n) & ((2 << level) - 1)]
    return np.where(node > 0, mine / np.maximum(node, 1e-300), 0.5)


def _given(cover: np.ndarray, leaves: np.ndarray, fixed: Sequence[bool]) -> np.ndarray:
    """(leaves): the expected value for a row of each leaf whose ``fixed`` levels are known."""
    n = len(leaves)
    agree = np.ones((n, n))
    number = np.arange(n)
    for level, known in enumerate(fixed):
        if known:
            agree *= (number[:, None] >> level & 1) == (number[None] >> level & 1)
        else:
            agree *= _ways(cover, level)[None]
    return agree @ leaves


def _expected(cover: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    return _given(cover, leaves, [False] * (len(leaves).bit_length() - 1))


def borders(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """For each feature its distinct quantiles, ``bins`` - 1 at most, as borders between bins; NaN and nulls aside."""
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    found = rows.agg(*[F.percentile_approx(known(f), at, 10_000).alias(f) for f in features]).first()
    return [np.unique(np.asarray(found[f] or [], np.float64)) for f in features]


GROUPS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("aside", T.BooleanType()), T.StructField("bins", T.BinaryType()),
    T.StructField("gain", T.BinaryType()), T.StructField("score", T.BinaryType()),
])


def packed_groups(rows: DataFrame, group: str, label: str, features: Sequence[str], cuts: list[np.ndarray], aside: Column) -> DataFrame:
    """One row a group: its binned features, labels and scores (0) as arrays of bytes. Groups without a positive label teach nothing and go."""
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
    row = F.struct(F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), *[value(f).alias(f"f{i}") for i, f in enumerate(features)])
    lists = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.bool_or(aside).alias("aside"), F.sort_array(F.collect_list(row)).alias("rows"))
    lists = lists.filter(F.exists("rows", lambda r: r["y"] > 0)).select("aside", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for aside_, held in zip(batch.column("aside"), batch.column("rows"), strict=True):
                flat = held.values.flatten()
                x = np.array([np.searchsorted(c, f.to_numpy(zero_copy_only=False), side="left") for c, f in zip(cuts, flat[1:], strict=True)], np.uint8)
                for i, f in enumerate(flat[1:]):  # NaN lies below all borders
                    x[i, np.isnan(f.to_numpy(zero_copy_only=False))] = 0
                n = len(held.values)
                out.append((n, aside_.as_py(), x.T.tobytes(), flat[0].to_numpy(zero_copy_only=False).tobytes(), bytes(8 * n)))
            yield pa.RecordBatch.from_pylist([dict(zip(GROUPS.names, o, strict=True)) for o in out], schema=_ARROW)

    return lists.mapInArrow(run, GROUPS)


_ARROW = pa.schema([("n", pa.int64()), ("aside", pa.bool_()), ("bins", pa.binary()), ("gain", pa.binary()), ("score", pa.binary())])


@dataclass
class _Level:
    """What a pass over the groups works with: the trees since the scores were kept, and the levels of the tree that grows."""

    n_features: int
    n_bins: int
    since: list[tuple[list[tuple[int, int]], np.ndarray]]
    grown: list[tuple[int, int]]

    def opened(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(bins, labels, scores, begin of each group, aside by row) of a batch's groups, laid end to end."""
        join = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
        n = batch.column("n").to_numpy()
        x = join("bins", np.uint8).reshape(-1, self.n_features)
        score = join("score", np.float64).copy()
        for splits, leaves in self.since:
            score += leaves[_leaf(x, splits)]
        return x, join("gain", np.float64), score, np.cumsum(n) - n, np.repeat(batch.column("aside").to_numpy(zero_copy_only=False), n)

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of gradient, curvature and rows by leaf, feature and bin; with the losses of both kinds of groups before them."""
        leaves = 1 << len(self.grown)
        size = leaves * self.n_features * self.n_bins
        total = np.zeros((3, size), np.int64)
        loss = np.zeros(4, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, score, begin, aside = self.opened(batch)
            g, h, lost = softmax_gradients(y, score, begin)
            first_aside = aside[begin]
            loss += [int(lost[~first_aside].sum()), int((~first_aside).sum()), int(lost[first_aside].sum()), int(first_aside.sum())]
            mine = ~aside
            x, g, h = x[mine], g[mine], h[mine]
            at = _leaf(x, self.grown) * self.n_features
            for f in range(self.n_features):
                cell = (at + f) * self.n_bins + x[:, f]
                order = np.argsort(cell, kind="stable")
                cells, start = np.unique(cell[order], return_index=True)
                for i, v in enumerate((g, h, np.ones_like(g))):
                    if len(cells):
                        total[i, cells] += np.add.reduceat(v[order], start)
        held = np.flatnonzero(total[2])
        columns = [np.concatenate([[-2, -1], held]), np.concatenate([[loss[0], loss[2]], total[0, held]]), np.concatenate([[0, 0], total[1, held]]), np.concatenate([[loss[1], loss[3]], total[2, held]])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["at", "g", "h", "n"])

    def rescored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = self.opened(batch)[2] if batch.num_rows else np.zeros(0)
            ends = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())]).astype(np.int64)
            made = pa.array([score[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in GROUPS.names[:-1]] + [made], names=GROUPS.names)


def _leaf(x: np.ndarray, splits: Sequence[tuple[int, int]]) -> np.ndarray:
    """Leaf numbers of binned rows: bit k is set where the bin is above the k-th split's."""
    out = np.zeros(len(x), np.int64)
    for k, (f, b) in enumerate(splits):
        out |= (x[:, f] > b).astype(np.int64) << k
    return out


def softmax_gradients(y: np.ndarray, score: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, curvature of each row; loss of each group) of the listwise softmax, in units of ``UNIT``.

    The loss of a group is the cross entropy between its labels, scaled to sum 1, and the softmax of its scores.
    """
    size = np.diff(np.append(begin, len(y)))
    owner = np.repeat(np.arange(len(begin)), size)
    top = np.maximum.reduceat(score, begin)
    e = np.exp(score - top[owner])
    p = e / np.add.reduceat(e, begin)[owner]
    share = y / np.add.reduceat(y, begin)[owner]
    lost = -np.add.reduceat(share * np.log(np.maximum(p, 1e-300)), begin)
    return np.rint((share - p) / UNIT).astype(np.int64), np.rint(p * (1 - p) / UNIT).astype(np.int64), np.rint(lost / UNIT).astype(np.int64)


def _best_split(hist: np.ndarray, l2: float) -> tuple[int, int]:
    """(feature, bin) of the border that gains most over all leaves together; the first of equal ones.

    ``hist`` is (3, leaves, features, bins). A border with no row on one side of every leaf gains nothing.
    """
    g, h = hist[0] * UNIT, hist[1] * UNIT
    left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
    right_g, right_h = g.sum(2, keepdims=True) - left_g, h.sum(2, keepdims=True) - left_h
    gain = (left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2)).sum(0)
    f, b = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
    return int(f), int(b)


def train(
    rows: DataFrame, group: str, label: str, features: Sequence[str], write, trees: int = 100, depth: int = 6, rate: float = 0.05, l2: float = 10.0,
    bins: int = 64, aside: Column | None = None, patience: int = 80,
) -> Trees:
    """Trees that rank the rows of each ``group`` by ``label`` (winner, or participant + winner).

    ``write(name, df)`` writes a table where all executors can read it, and returns it. Groups for which ``aside``
    holds are kept out of training; with them, training ends when their loss has not fallen for ``patience`` trees, and
    the trees up to the lowest loss are returned.
    """
    if not 1 < bins <= 256:
        raise ValueError("a bin is one byte")
    cuts = borders(rows, features, bins)
    state = write("groups", packed_groups(rows, group, label, features, cuts, F.lit(False) if aside is None else aside))
    n_bins = max(2, 1 + max((len(c) for c in cuts), default=1))
    since: list[tuple[list[tuple[int, int]], np.ndarray]] = []
    splits, values, covers, losses = [], [], [], []
    lowest = (float("inf"), 0)

    def totals(grown: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        level = _Level(len(features), n_bins, list(since), grown)
        sums = state.mapInArrow(level.histogram, "at long, g long, h long, n long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        hist = np.zeros((3, (1 << len(grown)) * len(features) * n_bins), np.int64)
        loss = np.zeros((2, 2))
        for at, g, h, n in sums.collect():  # a number of the model's size
            if at < 0:
                loss[at + 2] = g * UNIT, n
            else:
                hist[:, at] = g, h, n
        return hist.reshape(3, 1 << len(grown), len(features), n_bins), loss

    for number in range(trees + 1):
        hist, loss = totals([])
        mean = [float(s / n) if n else float("nan") for s, n in loss]
        losses.append((mean[0], mean[1]))
        if mean[1] < lowest[0] - 1e-12:
            lowest = mean[1], number
        stale = loss[1, 1] > 0 and number - lowest[1] >= patience
        if number == trees or stale or not loss[0, 1]:
            break
        grown: list[tuple[int, int]] = []
        for level in range(depth):
            grown.append(_best_split(hist, l2))
            hist, _ = totals(grown)
        g, h, n = hist[:, :, 0].sum(2)  # any feature's bins hold all rows of a leaf
        leaves = rate * (g * UNIT) / (h * UNIT + l2)
        since.append((grown, leaves))
        splits.append(grown)
        values.append(leaves)
        covers.append(n)
        if len(since) == KEEP_EVERY:
            level = _Level(len(features), n_bins, since, [])
            state = write(f"scores{number}", state.mapInArrow(level.rescored, GROUPS))
            since = []
    best = lowest[1] if loss[1, 1] else len(splits)
    border = lambda f, b: cuts[f][b] if b < len(cuts[f]) else np.inf
    model = Trees(
        tuple(features),
        np.array([[f for f, _ in s] for s in splits], np.int64).reshape(-1, depth),
        np.array([[border(f, b) for f, b in s] for s in splits], np.float64).reshape(-1, depth),
        np.array(values, np.float64).reshape(-1, 1 << depth),
        np.array(covers, np.int64).reshape(-1, 1 << depth),
        tuple(losses),
    )
    return model.first(best)


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """(rows, features) of the columns __0, __1, ...; nulls and NaN as what lies below every border."""
    x = np.column_stack([batch.column(f"__{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(np.float64)
    x[np.isnan(x)] = -np.inf
    return x


def score(rows: DataFrame, model: Trees, out: str = "tree_score", shares: str | None = None) -> DataFrame:
    """``rows`` with the model's score and, by the name ``shares``, an array of each feature's part of it (score - bias in sum)."""
    own = rows.columns
    inputs = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"__{i}") for i, f in enumerate(model.features)]
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    if shares:
        schema = schema.add(shares, T.ArrayType(T.DoubleType()))
    table = model.shares() if shares else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, model.features)
            made = [pa.array(model.scores(x))]
            if table is not None:
                at, parts = model.leaf_numbers(x), np.zeros((len(x), len(model.features)))
                for t in range(at.shape[1]):
                    parts += table[t, at[:, t]]
                made.append(pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * parts.shape[1], pa.array(parts.ravel())))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], *made], names=schema.names)

    return rows.select("*", *inputs).mapInArrow(run, schema)


def reasons(shares: str, features: Sequence[str], groups: Mapping[str, tuple[Sequence[str], str]], most: int = 3) -> Column:
    """Names of the groups of features that lift a row's score most: sums above 1e-6 only, groups whose condition fails aside, equal ones in the given order."""
    parts = []
    for place, (name, (names, holds)) in enumerate(groups.items()):
        total = F.lit(0.0)
        for f in names:
            total = total + F.get(F.col(shares), F.lit(list(features).index(f)))
        parts.append(F.struct((-F.when(F.expr(holds), total).otherwise(0.0)).alias("less"), F.lit(place).alias("place"), F.lit(name).alias("group")))
    good = F.filter(F.array_sort(F.array(*parts)), lambda p: p["less"] < -1e-6)
    return F.transform(F.slice(good, 1, most), lambda p: p["group"])
