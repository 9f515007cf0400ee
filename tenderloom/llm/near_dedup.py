"""MinHash near-duplicate groups by a multi-index Hamming join.

A document's set holds its distinct shingles of ``k`` words. Its signature is ``VALUES`` minimum hashes, ``BITS``
bits kept of each, in ``CHUNKS`` chunks. Two signatures that differ in at most ``ERRORS * CHUNKS + CHUNKS - 1``
values agree, by the pigeonhole principle, in all but ``ERRORS`` values of some chunk; with one error allowed every
chunk is entered once with each value left out, so such a pair always meets under some key. A pair at the threshold
of similarity differs that much with a probability below one in a billion.

Rows that meet under a key are never expanded into all pairs:

1. equal sets are one class from the start; classes are numbered in the order of their smallest ids, so that the
   smallest number of a group stands for its smallest id;
2. every class is laid beside the smallest class under each of its keys: inside a task by the signatures, of which only
   the nearest stays, between tasks by the number of keys that two share. So a class is confirmed on the full sets
   against two others at most, and the links give components;
3. only keys under which several components meet are looked at again, in rounds: there the signatures of different
   components are compared block by block, and near ones by odd sketches, whose distance is never above that of the
   sets: what differs by more than the threshold allows is refuted at once. Keys with many rows are cut into cells of
   ``CELL`` by ``CELL`` rows that go to different tasks. Of the pairs left a task gives only a few spanning forests over
   its components, no more than ``FORESTS`` rows a class in the first rounds; they are confirmed on the full sets and
   joined. Pairs that fail are remembered, and the next round reads only keys under which several components still meet.
   The last rounds give every pair that is left, so that no link is lost.

So every link between different texts is found unless two components are already joined without it. Shingles are
64-bit hashes of their words.

Defined results: null and empty texts have an empty set and are linked with nothing; a text of fewer than ``k``
words has one shingle, its whole word sequence; rows with one id are judged each by its own text and linked as any
others; a null id is larger than any other; equal sets are linked whatever their order of words; an empty table gives
an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.shared import Tables, shuffle_parts
from tenderloom.llm.words import NOT_BLANK, blocks, in_text, mix, tokenise

CHUNKS, PER_CHUNK, BITS = 16, 4, 16
VALUES = CHUNKS * PER_CHUNK
#: Allowed differing values in a chunk: one key for each value left out.
ERRORS = 1
KEYS = CHUNKS * PER_CHUNK
#: Rows of one key that one task compares with as many others.
CELL = 4096
#: Spanning forests that a task gives in each round; then all pairs that are left.
FORESTS = (1, 8, 64)
#: So many links are joined in one task.
FEW_LINKS = 15_000
#: The least bits of an odd sketch.
ODD_BITS = 256
#: Up to this many ids are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000

_SALTS = np.random.default_rng(77).integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, bounds): the set of text i is ``hashes[bounds[i]:bounds[i + 1]]``, ascending."""
    tokens, _, owner, _ = tokenise(texts, NOT_BLANK)
    n = len(texts)
    first = in_text(owner, n)
    count = np.diff(first)
    span = max(len(tokens) - k + 1, 0)
    h = np.full(span, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + span]
    inside = owner[:span] == owner[k - 1 : k - 1 + span]
    at, h = owner[:span][inside], mix(h[inside])
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        whole = np.full(len(few), 1, np.uint64)
        for j in range(k - 1):
            more = count[few] > j
            whole[more] = whole[more] * np.uint64(0x9E3779B97F4A7C15) + tokens[first[few[more]] + j]
        at, h = np.concatenate([at, few]), np.concatenate([h, mix(whole + count[few].astype(np.uint64))])
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[fresh], in_text(at[fresh], n)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For non-empty sets only: (rows, signature values, 128-bit set fingerprint as two words)."""
    rows = np.flatnonzero(np.diff(bounds))
    starts = bounds[rows]
    full = mix(hashes + np.uint64(0x1234567))
    out = np.empty((len(rows), VALUES), "<u2")
    prints = np.zeros((len(rows), 2), np.uint64)
    if len(rows):
        for j, salt in enumerate(_SALTS):
            out[:, j] = (mix(np.minimum.reduceat(full * salt, starts)) & np.uint64(0xFFFF)).astype("<u2")
        prints[:, 0] = np.add.reduceat(full, starts)
        prints[:, 1] = np.add.reduceat(mix(full ^ np.uint64(0x777)), starts)
    return rows, out, prints


def odd_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set the parities of its shingles by hash, one bit a shingle or more, a power of two.

    The sketches of two sets differ in no more bits than the sets in shingles.
    """
    size = np.diff(bounds)
    bits = np.maximum(ODD_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    place = (mix(hashes ^ np.uint64(0x5BD1E995)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits(np.bincount(begin[owner] + place, minlength=begin[-1]).astype(np.uint8) & 1)
    return [data[a // 8 : b // 8].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]


def odd_distances(odd: list[bytes], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of each pair differ; the longer one is folded to the other's length."""
    length = np.array([len(x) for x in odd])
    least = np.minimum(length[p], length[q])
    out = np.zeros(len(p), np.int64)
    for n in np.unique(least):
        pairs = np.flatnonzero(least == n)
        rows, back = np.unique(np.concatenate([p[pairs], q[pairs]]), return_inverse=True)
        folded = np.zeros((len(rows), n), np.uint8)
        for i, r in enumerate(rows.tolist()):
            whole = np.frombuffer(odd[r], np.uint8)
            folded[i] = np.bitwise_xor.reduce(whole.reshape(-1, n), axis=0)
        step = max(1, 32_000_000 // int(n))
        for s in range(0, len(pairs), step):
            a, b = back[: len(pairs)][s : s + step], back[len(pairs) :][s : s + step]
            out[pairs[s : s + step]] = np.bitwise_count(folded[a] ^ folded[b]).sum(axis=1, dtype=np.int64)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_a, set_b, sig, odd): size, fingerprint, signature and odd sketch of every document's set."""

    def run(batches):
        for batch in batches:
            for first, part in blocks(batch.column(2)):
                hashes, bounds = shingle_sets(part, k)
                rows, sig, prints = signatures(hashes, bounds)
                sigs: list[bytes | None] = [None] * len(part)
                both = np.zeros((len(part), 2), np.int64)
                both[rows] = prints.view(np.int64)
                for r, s in zip(rows.tolist(), sig, strict=True):
                    sigs[r] = s.tobytes()
                same = [batch.column(i).slice(first, len(part)) for i in (0, 1)]
                columns = [*same, pa.array(np.diff(bounds)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sigs, pa.binary()), pa.array(odd_sketches(hashes, bounds), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig", "odd"])

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig binary, odd binary")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def _keys(sig: np.ndarray) -> np.ndarray:
    """KEYS keys of each signature: chunk by chunk, each value left out once."""
    chunks = sig.reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, PER_CHUNK), np.uint64)
    for d in range(PER_CHUNK):
        rest = [j for j in range(PER_CHUNK) if j != d]
        out[:, :, d] = sum(chunks[:, :, j] << np.uint64(BITS * i) for i, j in enumerate(rest))
    number = np.arange(KEYS, dtype=np.uint64).reshape(1, CHUNKS, PER_CHUNK)
    return mix((out | (number << np.uint64(48))) + np.uint64(1)).reshape(-1, KEYS)


def beside_smallest(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, keys) of classes (node, n_shingles, sig): what a class meets under its keys.

    ``keys`` is null for the nearest class of the same task, whose signature has been judged, else the number of keys
    under which ``b`` is the smallest of all. A row with ``a = b`` only tells that the class meets another.
    """
    most = limit_of(percent)

    def local(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                node = part.column(0).to_numpy(zero_copy_only=False)
                by_node = np.argsort(node, kind="stable")
                node, size = node[by_node], part.column(1).to_numpy(zero_copy_only=False)[by_node]
                sig = _values(part.column(2))[by_node]
                flat, owner = _keys(sig).ravel(), np.repeat(np.arange(len(node)), KEYS)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
                least = owner[fresh][np.cumsum(fresh) - 1]
                pairs = np.unique(owner[~fresh] * 4096 + least[~fresh])
                p, q = pairs // 4096, pairs % 4096
                met = np.unique(np.concatenate([p, q]))
                apart = np.concatenate([np.zeros(0, np.int64), *[(sig[p[i : i + 65536]] != sig[q[i : i + 65536]]).sum(axis=1) for i in range(0, len(p), 65536)]])
                good = (apart <= most) & (100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q]))
                p, q, apart = p[good], q[good], apart[good]
                order = np.lexsort((apart, p))
                p, q = p[order], q[order]
                _, best = np.unique(p, return_index=True)
                p, q = p[best], q[best]
                rest = np.setdiff1d(met, p, assume_unique=True)
                a, b = np.concatenate([p, rest]), np.concatenate([q, rest])
                yield pa.RecordBatch.from_arrays([pa.array(flat[fresh].view(np.int64)), pa.array(node[owner[fresh]]), pa.nulls(int(fresh.sum()), pa.int64())], names=["key", "a", "b"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(node[a]), pa.array(node[b])], names=["key", "a", "b"])

    def between(batches):
        last_key, least = None, None
        for batch in batches:
            key, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            fresh = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            group = np.cumsum(fresh) - (1 if fresh[0] else 0)
            heads = np.concatenate([[] if fresh[0] else [least], a[fresh]]).astype(np.int64)
            first = heads[group]
            last_key, least = key[-1], first[-1]
            both, n = np.unique(np.stack([a, first], axis=1)[~fresh & (a != first)], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n)], names=["a", "b", "keys"])

    tables = Tables(classes.sparkSession, "near")
    rows = tables.write("keys", classes.select("node", "n_shingles", "sig").mapInArrow(local, "key long, a long, b long"))
    parts = shuffle_parts(classes.sparkSession)
    met = rows.filter("b is null").select("key", "a").repartition(parts, "key").sortWithinPartitions("key", "a").mapInArrow(between, "a long, b long, keys long")
    met = met.groupBy("a", "b").agg(F.sum("keys").alias("keys"))
    out = tables.write("beside", met.unionByName(rows.filter("b is not null").select("a", "b", F.lit(None).cast("long").alias("keys"))))
    tables.drop("keys")
    return out


def limit_of(percent: int) -> int:
    """Differing values that a pair at the threshold stays within but for about four in a million."""
    p = 1 - percent / 100
    return min(ERRORS * CHUNKS + CHUNKS - 1, int(np.ceil(VALUES * p + 4.5 * np.sqrt(VALUES * p * (1 - p)))))


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
    most = limit_of(percent)

    def run(batches):
        for batch in batches:
            keep = pa.array((_values(batch.column(2)) != _values(batch.column(3))).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return rows.mapInArrow(run, "a long, b long")


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, tables: Tables) -> DataFrame:
    """(node, text) of the named classes: the text of the row that stands for the class, once."""
    named = tables.write("named", classes.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).join(nodes, "node"))
    rows = _hashed(docs)
    found = rows.join(_small(named), rows["doc_id"].eqNullSafe(named["id"]) & (rows["text_hash"] == named["hash"]))
    return tables.write("texts", found.groupBy("node").agg(F.first("text").alias("text")))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with ``100 * intersection >= percent * union`` on the full sets, as a written table."""
    tables = Tables(docs.sparkSession, "near")
    texts = _texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), tables)

    def run(batches):
        for batch in (b.slice(s, 256) for b in batches for s in range(0, b.num_rows, 256)):
            hit = []
            for first, left in blocks(batch.column(2)):
                x, bx = shingle_sets(left, k)
                y, by = shingle_sets(batch.column(3).slice(first, len(left)).cast(pa.binary()).fill_null(b"").to_pylist(), k)
                for i in range(len(left)):
                    u, v = x[bx[i] : bx[i + 1]], y[by[i] : by[i + 1]]
                    same = len(np.intersect1d(u, v, assume_unique=True))
                    hit.append(same > 0 and 100 * same >= percent * (len(u) + len(v) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    found = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
    out = tables.write("links", found)
    tables.drop("named", "texts")
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all nodes of a few links (a, b)."""
    held = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches if b.num_rows]
    if held:
        names, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        label = np.arange(len(names))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["node", "component"])


def _labels(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b), a written table: the smallest node reachable.

    Up to ``FEW_LINKS`` links are joined in one task. More are joined in rounds, each of which takes the least label
    among the neighbours and then the label's own label, so that chains shorten to half; a round is written before the
    next reads it. Only a count reaches the driver.
    """
    tables = Tables(links.sparkSession, "near")
    if links.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return tables.write("few", links.select("a", "b").repartition(1).mapInArrow(_joined, "node long, component long"))
    both = tables.write("both", links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tables.write("step", both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        least = tables.write("least", labels.join(heard, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now")))
        jump = least.select(F.col("node").alias("now"), F.col("now").alias("further"))
        step = least.join(jump, "now", "left").select("node", F.least("now", "further").alias("component"), (F.col("was") != F.least("now", "further")).alias("moved"))
        tables.drop("step")
        step = tables.write("step", step)
        tables.drop("least")
        labels = step.select("node", "component")
        if not step.filter("moved").limit(1).count():
            break
    tables.drop("both")
    return labels


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) for nodes (node) under links (a, b), a written table: the smallest node reachable."""
    return nodes.select("node").join(_labels(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def rejoined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links (a, b) between nodes: components are joined, not nodes anew."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    moved = _labels(Tables(labels.sparkSession, "near").write("between", between)).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return labels.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))


def _keyed(active: DataFrame) -> DataFrame:
    """(key, number, node, component): every key of every class."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                keys = _keys(_values(part.column(1)))
                at = pa.array(np.repeat(np.arange(len(keys)), KEYS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(KEYS), len(keys))), *[part.column(i).take(at) for i in (0, 2)]],
                    names=["key", "number", "node", "component"],
                )

    return active.select("node", "sig", "component").mapInArrow(run, "key long, number long, node long, component long")


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, n): keys under which several components meet."""
    return rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")


def forests(comp_a: np.ndarray, comp_b: np.ndarray, apart: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """Which pairs join what is apart under one of ``labels`` (a label for each component), the nearest first; labels are joined.

    Each of the ``labels`` grows its own forest of pairs that no earlier one has taken.
    """
    left, out = np.arange(len(apart)), []
    for label in labels:
        a, b = label[comp_a[left]], label[comp_b[left]]
        open_ = np.flatnonzero(a != b)
        low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        order = np.lexsort((apart[left[open_]], high, low))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        some = open_[order[fresh]]
        taken = []
        for i in some[np.argsort(apart[left[some]], kind="stable")].tolist():
            x, y = label[comp_a[left[i]]], label[comp_b[left[i]]]
            if x != y:
                label[label == y] = x
                taken.append(i)
        out.append(left[taken])
        left = np.delete(left, taken)
        if not len(left):
            break
    return np.concatenate(out) if out else left


#: Keys of so many rows or fewer are compared together, a batch at a time.
FEW_ROWS = 64


def candidates(active: DataFrame, percent: int, n_forests: int | None) -> DataFrame:
    """Pairs (a, b) of classes (node, n_shingles, sig, odd, component, failed) of different components that meet under a key and may be linked.

    Only as many forests of them as asked for by each task's batch; all of them with None. ``failed`` lists those refuted
    before. A row with ``a = b`` names a class that has pairs beyond those given.
    """
    most = limit_of(percent)
    rows = _keyed(active)
    met = rows.join(_mixed(rows), "key")
    full = met.join(active.select("node", "n_shingles", "sig", "odd", "failed"), "node")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), cells).cast("int")
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    full = full.select("key", "number", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") == F.least("own", "other")).alias("left"), "node", "component", "n_shingles", "sig", "odd", "failed")

    def together(group: np.ndarray, size: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of one group, for groups of few rows; rows of group -1 are left out."""
        count = np.bincount(group[group >= 0], minlength=1)
        few = np.flatnonzero((group >= 0) & (count[np.maximum(group, 0)] <= FEW_ROWS))
        for step in range(1, FEW_ROWS):
            p, q = few[:-step], few[step:]
            same = group[p] == group[q]
            if not same.any():
                break
            good = same & (comp[p] != comp[q]) & (100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q]))
            yield p[good], q[good]

    def crowded(rows: np.ndarray, left: np.ndarray, inner: bool, size: np.ndarray, comp: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of a cell of many rows, a block of rows at a time; their signatures are near."""
        a, b = (rows, rows) if inner else (rows[left[rows]], rows[~left[rows]])
        for s in range(0, len(a), 256):
            x = a[s : s + 256]
            apart = np.zeros((len(x), len(b)), np.int16)
            for v in range(VALUES):
                apart += sig[x, v][:, None] != sig[b, v][None, :]
            n, m = size[x][:, None], size[b][None, :]
            good = (apart <= most) & (comp[x][:, None] != comp[b][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if inner:
                good &= x[:, None] < b[None, :]
            r, c = np.nonzero(good)
            yield x[r], b[c]

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """What whole groups of rows give."""
        what = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
        group = np.cumsum(np.concatenate([[False], (what[1:] != what[:-1]).any(axis=1)]))
        number, left, ids, comp, size = (t.column(c).to_numpy() for c in ("number", "left", "node", "component", "n_shingles"))
        names, comp = np.unique(comp, return_inverse=True)
        sig, odd = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, VALUES), t.column("odd").to_pylist()
        refuted = {(int(n), f) for n, fs in zip(ids, t.column("failed").to_pylist(), strict=True) for f in fs or ()}
        labels = [np.arange(len(names)) for _ in range(n_forests or 0)]
        pairs, more = [np.zeros((2, 0), np.int64)], np.zeros(len(ids), bool)
        inner = what[:, 1] == what[:, 2]
        many = [crowded(np.arange(a, b), left, bool(inner[a]), size, comp, sig) for a, b in _runs(group) if b - a > FEW_ROWS or not inner[a]]
        for p, q in itertools.chain(together(np.where(inner, group, -1), size, comp), itertools.chain(*many)):
            near = np.concatenate([np.zeros(0, bool), *[(sig[p[i : i + 65536]] != sig[q[i : i + 65536]]).sum(axis=1) <= most for i in range(0, len(p), 65536)]])
            p, q = p[near], q[near]
            mine = first_key(sig[p], sig[q]) == number[p]  # a pair is looked at under one key only
            p, q = p[mine], q[mine]
            differ = odd_distances(odd, p, q)
            # percent of the union is common: (100 + percent) * difference <= (100 - percent) * (n + m)
            near = (100 + percent) * differ <= (100 - percent) * (size[p] + size[q])
            p, q, differ = p[near], q[near], differ[near]
            if refuted:
                new = np.array([(u, w) not in refuted for u, w in zip(ids[p].tolist(), ids[q].tolist(), strict=True)], bool)
                p, q, differ = p[new], q[new], differ[new]
            if n_forests:
                chosen = forests(comp[p], comp[q], differ / (size[p] + size[q]), labels)
                over = np.ones(len(p), bool)
                over[chosen] = False
                more[p[over]] = more[q[over]] = True
                p, q = p[chosen], q[chosen]
            pairs.append(np.stack([np.maximum(ids[p], ids[q]), np.minimum(ids[p], ids[q])]))
        high, low = np.unique(np.concatenate(pairs, axis=1), axis=1)
        rest = np.unique(ids[more])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([high, rest])), pa.array(np.concatenate([low, rest]))], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            what = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((what[1:] != what[:-1]).any(axis=1)) + 1
            if held and not (what[0] == last).all():
                yield from compare(pa.Table.from_batches(held))
                held = []
            last, end = what[-1], int(cuts[-1]) if len(cuts) else 0
            if end:  # the batch's last group may go on in the next
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
            held.append(batch.slice(end))
        if held:
            yield from compare(pa.Table.from_batches(held))

    parts = shuffle_parts(active.sparkSession)
    return full.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first key that two signatures share, row by row; they share one."""
    same = (a == b).reshape(-1, CHUNKS, PER_CHUNK)
    rest = same.sum(axis=2)[:, :, None] - same
    return (rest.reshape(len(a), KEYS) == PER_CHUNK - 1).argmax(axis=1) if len(a) else np.zeros(0, np.int64)


def _runs(group: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal neighbours."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def across(classes: DataFrame, met: DataFrame, links: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[int]]:
    """(labels (node, component) of the nodes ``met``, with every link that ``links`` left out; pairs confirmed in each round)."""
    tables = Tables(docs.sparkSession, "near")
    labels, counts = tables.write("labels0", components(met, links)), []
    failed = open_ = None
    for number in itertools.count():
        active = classes.select("node", "n_shingles", "sig", "odd").join(labels, "node")
        if failed is None:
            active = active.withColumn("failed", F.lit(None).cast("array<long>"))
        else:
            both = failed.select("a", "b").unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
            active = active.join(open_, "node", "left_semi").join(both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed")), "node", "left")
        found = tables.write(f"found{number}", candidates(active, percent, FORESTS[number] if number < len(FORESTS) else None))
        pairs, more = found.filter("a <> b"), found.filter("a = b").select(F.col("a").alias("node"))
        n = pairs.count()
        if not n:
            return labels, counts
        counts.append(n)
        kept = confirm(pairs, classes, docs, k, percent)
        refuted = pairs.join(kept, ["a", "b"], "left_anti")
        failed = tables.write(f"failed{number + 1}", refuted if failed is None else failed.unionByName(refuted))
        labels = tables.write(f"labels{number + 1}", rejoined(labels, kept))
        open_ = tables.write(f"open{number + 1}", more)
        tables.drop(f"found{number}", f"failed{number}", f"labels{number}", f"open{number}")
        if not open_.limit(1).count():
            return labels, counts


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, stands): ``stands`` for rows that are the first of their group."""
    tables = Tables(docs.sparkSession, "near")
    sketches = tables.write("sketches", sketch(docs, k))
    full = sketches.filter("sig is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    sets = full.groupBy("set_a", "set_b").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    sets = sets.select("least.*", "set_a", "set_b", "n_shingles", "sig", "odd").orderBy("none", "doc_id", "text_hash", "set_a", "set_b")
    classes = tables.write("classes", sets.withColumn("node", F.monotonically_increasing_id()))
    beside = beside_smallest(classes, percent)
    most_keys = beside.filter("keys is not null").groupBy("a").agg(F.max_by("b", F.struct("keys", -F.col("b"))).alias("b"))
    chosen = near_pairs(most_keys, classes, percent).unionByName(beside.filter("keys is null and a <> b").select("a", "b"))
    links = confirm(tables.write("chosen", chosen.distinct()), classes, docs, k, percent)
    met = tables.write("met", beside.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    labels, _ = across(classes, met, links, docs, k, percent)
    tables.drop("chosen", "met")
    grouped = classes.select("node", "set_a", "set_b", F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = grouped.join(classes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id")), "component")
    linked = full.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(grouped, ["set_a", "set_b"])
    stands = (F.col("node") == F.col("component")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    linked = linked.select("doc_id", "text_hash", "n_shingles", "component_id", stands.alias("stands"))
    alone = sketches.filter("sig is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stands"))
    return linked.unionByName(alone)


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links of ``percent`` similarity reach."""
    return _judged(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one a group stays: the smallest id's, once.

    Rows are told apart by id and text, so a row goes only if its own text is linked; texts without a word all stay.
    """
    tables = Tables(docs.sparkSession, "near")
    groups = tables.write("judged", _judged(docs, k, percent))
    gone = groups.filter("not stands").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    twice = groups.filter("stands and n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash"))
    left = docs.join(_small(gone), same, "left_anti")
    if not twice.limit(1).count():
        return left
    again = docs.join(_small(twice), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(_small(twice), same, "left_anti").unionByName(again)
