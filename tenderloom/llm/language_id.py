"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1-, 2- and 3-grams of the lower-cased text are hashed to a fixed number of features. Document
frequencies are counted over every labelled training document by Spark; the weights are learned with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) from a sample of labelled documents, at
most about ``SAMPLE_PER_LANGUAGE`` of each language chosen by a hash of the id; a fifth of that sample only sets
the temperature that calibrates the scores. The model has a fixed size and is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no labelled document every
text is ``und``; equal texts get equal predictions; a tie takes the alphabetically first language; whole texts are
read, however long; columns not named in ``keep`` are dropped. A learned prediction has a score above 0, up to 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.words import spans

#: Hashed features of 1-, 2- and 3-grams.
SIZES = (1 << 10, 1 << 12, 1 << 14)
FEATURES = sum(SIZES)
#: Labelled documents of each language that the weights may be learned from (expected number).
SAMPLE_PER_LANGUAGE = 600
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Occurrences of each hashed n-gram."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, key = [], np.zeros(len(at), np.uint64)
    for n, size in enumerate(SIZES):
        if len(at) <= n:
            out.append(np.zeros(size, np.int64))
            continue
        key = key[: len(at) - n] * np.uint64(0x100000001B3) + at[n:] + np.uint64(1)
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)
        out.append(np.bincount(slot.astype(np.int64), minlength=size))
    return np.concatenate(out)


def weigh(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and TF-IDF values, scaled to unit length."""
    at = np.flatnonzero(found)
    value = np.log1p(found[at]) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, (value / norm if norm else value)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def scores(self, text: str) -> np.ndarray:
        at, value = weigh(counts(text), self.idf)
        return _softmax((value @ self.weights[at]) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (features x classes) after ``epochs`` passes over (indices, values, class)."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def now(z, n):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            za, na = z[at], n[at]
            w = now(za, na)
            p = _softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p[None, :]
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / alpha * w
            n[at] = more
    return now(z, n).astype(np.float32)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, g = np.log(0.02), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and documents in all; every task sends its own sums."""

    def run(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, texts in spans(batch.column(0)):
                for text in texts.to_pylist():
                    df += counts(text) > 0
                n += len(texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "df"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(FEATURES, np.int64)
    total = 0
    for feature, df in rows:
        if feature < 0:
            total = df
        else:
            out[feature] = df
    return out, total


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learn from rows (doc_id, text, lang); rows with a null language are left out."""
    labelled = docs.filter("lang is not null").withColumn("text", F.coalesce("text", F.lit("")))
    frequencies, total = document_frequencies(labelled)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("sample")), F.lit(1_000_000)) / 1e6
    chosen = labelled.filter(draw < F.element_at(share, F.col("lang")))

    def run(batches):
        for batch in batches:
            found = [weigh(counts(t), idf) for _, texts in spans(batch.column("text")) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("aside"), pa.array([at.astype("<i4").tobytes() for at, _ in found]), pa.array([v.astype("<f4").tobytes() for _, v in found])],
                names=["lang", "aside", "at", "value"],
            )

    aside = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("aside")), F.lit(5)) == 0).alias("aside")
    rows = chosen.select("text", "lang", aside, "doc_id").orderBy("doc_id").drop("doc_id").mapInArrow(run, "lang string, aside boolean, at binary, value binary").collect()
    place = {lang: i for i, lang in enumerate(languages)}
    cases = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float), place[r["lang"]], r["aside"]) for r in rows]
    fit = [c[:3] for c in cases if not c[3]] or [c[:3] for c in cases]
    weights = ftrl(fit, len(languages))
    held = [c for c in cases if c[3]]
    logits = np.array([value @ weights[at] for at, value, _, _ in held]).reshape(-1, len(languages))
    return Model(languages, idf, weights, calibrate(logits, np.array([c[2] for c in held], np.int64)))


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def predict(docs: DataFrame, model: Model | None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, texts in spans(batch.column("__text")):
                for text in texts.to_pylist():
                    lang, score = _named(model, text)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _named(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return "und", 0.0
    p = model.scores(text)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def confident(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs``, with their own columns only, whose language is named with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [_named(model, text)[1] for _, texts in spans(batch.column("text")) for text in texts.to_pylist()]
            yield batch.filter(pa.array([s > 0 and s >= least for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Documents the model never learns from: ``crc32`` of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
