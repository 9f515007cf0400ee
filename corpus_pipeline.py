"""A training corpus from ``documents``, in five stages.

1. language_id: texts without a letter, and those whose language stays uncertain, go;
2. near_dedup: of documents with 80 % of their five-word shingles in common, chained, one stays;
3. decontaminate: documents that overlap a benchmark item go;
4. secret_scan: secrets are replaced by ``[SECRET]``;
5. encode: token ids, decoded again as proof.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; stages 1 to 4 return the columns
of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm import byte_bpe, decontaminate, language_id, near_dedup, secret_ledger
from tenderloom.llm.queries import vocabulary_bytes
from tenderloom.llm.shared import Tables, shared_folder, table

#: A language scored below this is as good as a guess among four.
LEAST_SCORE = 0.3
#: SQL cannot express the trained and hashed stages; tests hold run() against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.confident(docs, model, LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redacted(docs, shared_folder(spark, "pipeline-ledger"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(docs, vocabulary_bytes(), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), proof=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_copies),
    ("decontaminate", without_benchmark),
    ("secret_scan", without_secrets),
    ("encode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs, read = Tables(spark, "pipeline"), table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = tables.write(name, stage(spark, docs, sf_dir))
        tables.drop(*read)
        read = (name,)
    return STAGES[-1][1](spark, docs, sf_dir)
