import numpy as np
from pyspark.sql import functions as F

from tenderloom.llm import language_id
from tenderloom.llm.queries import op6_language_id, table

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = op6_language_id(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["right"] >= 0.95 and 0 < r["low"] and r["high"] <= 1


def test_unknown_and_untaught(spark, docs, none):
    model = language_id.train(docs)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, keep=("doc_id", "text")).collect()}
    for (_, text), (lang, score) in got.items():
        assert (lang, score) == ("und", 0.0) if not language_id.has_letter(text) else lang == "en" and 0 < score <= 1
    assert language_id.train(none) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0
    assert language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None


def test_learning_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = [(np.array([k, 5 + i % 3]), np.array([0.8, 0.6]), k) for i in range(200) for k in (0, 1)]
    w = language_id.ftrl(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and not w[100:].any()
    logits = rng.normal(size=(2000, 2)) * 8
    p = 1 / (1 + np.exp(-(logits[:, 1] - logits[:, 0]) / 4))
    assert 3 < language_id.calibrate(logits, (rng.random(2000) < p).astype(int)) < 5


def test_signs_are_no_letters_and_own_columns_stay(spark, docs):
    assert not any(map(language_id.has_letter, ("½", "²³", "Ⅷ", "１２", "☃ _ 1", "", None))) and all(map(language_id.has_letter, ("é", "文", "ª")))
    rows = [(i, "these are words of a text", "en", 7, "mine") for i in range(20)] + [(90, "½ Ⅷ", "en", 8, "x"), (None, "no id but words", "en", 9, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    kept = language_id.confident(df, language_id.train(df), 0.3)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in df.collect() if r["doc_id"] != 90], key=str)
