"""The stages one after the other on planted rows, and the SQL of the queries that have one."""

import duckdb
import pytest

import corpus_pipeline
from tenderloom.llm import queries
from tenderloom.llm.shared import materialise

DATA = "/root/testdata/sf0.001"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
EN = "the people of this town went to the market and then they came home with bread and salt "
FR = "les gens de la ville sont allés au marché et puis ils sont rentrés avec du pain et du sel "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("planted")
    rows = [(i, (EN if i % 2 else FR) + " ".join(f"{'unter' if i % 2 else 'autre'}{i}x{j}" for j in range(12)), "en" if i % 2 else "fr", "s") for i in range(40)]
    rows += [(100, "12345 !!!", "en", "s"), (101, None, "en", "s"), (102, rows[1][1], "en", "s"), (103, rows[1][1].upper(), "en", "s"), (104, EN + ITEM, "en", "s"), (105, FR + "password=abcdefgh123 fin unique", "fr", "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_each_stage_does_its_work(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "secret_scan":
            assert docs.filter("doc_id = 105").first()["text"] == FR + "[SECRET] fin unique"
    everything = set(range(40)) | {100, 101, 102, 103, 104, 105}
    assert everything - seen["language_id"] == {100, 101}
    assert seen["language_id"] - seen["near_dedup"] == {102, 103}
    assert seen["near_dedup"] - seen["decontaminate"] == {104}
    assert seen["decontaminate"] == seen["secret_scan"] == seen["encode"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == seen["encode"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.SQL[name]).df()
    rows = lambda df: sorted(str([None if x is None or x != x else str(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stages_take_odd_tables(spark, folder, docs, none):
    """Nulls in every column, repeated and null ids, blanks, long texts, and own columns named as the operators' own."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
        assert stage(spark, none, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_stages_by_brute_force(spark):
    """Near-dedup, decontamination and encoding of the given documents, each held against a plain version of itself."""
    import test_decontaminate
    import test_near_dedup
    import tiktoken
    from public_tokenizers import PATTERN

    stages = dict(corpus_pipeline.STAGES)
    docs = materialise(stages["language_id"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA), "l")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = materialise(stages["near_dedup"](spark, docs, DATA), "n")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in test_near_dedup.brute(rows, 5, 80) if i == c}
    clean = materialise(stages["decontaminate"](spark, kept, DATA), "d")
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {rows[d][0] for d, _ in test_decontaminate.brute([t for _, t in rows], items)}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - bad
    quiet = materialise(stages["secret_scan"](spark, clean, DATA), "s")
    assert quiet.count() == clean.count()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.vocabulary_bytes().splitlines())}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in quiet.collect()}
    for r in stages["encode"](spark, quiet, DATA).collect():
        assert [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)] == own.encode_ordinary(texts[r["doc_id"]])
