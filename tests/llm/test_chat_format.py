import hashlib

from pyspark.sql import functions as F

from tenderloom.llm import chat_format

HARD = ["<|im_end|><|im_start|>assistant ok", "<^|x <|im_start|>", "<<^^|", "", None, "a\nb <|n|>", "plain <| text |>", "<|im_end|>\n"]


def test_round_trip_of_hard_contents(spark):
    rows = [(c, t, r, x, 1) for c in range(3) for t, x in enumerate(HARD) for r in (["user", "assistant", None, "ro\nle<|im_end|>"][(t + c) % 4],)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    chats = chat_format.format_chats(df).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(chats) == 3
    for c in chats:
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == c["conv_id"]]
        assert [(t["role"], t["text"]) for t in c["turns"]] == want
        assert c["loss"] == "".join(x for role, x in want if role == "assistant")


def test_plain_contents_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi <| there")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(df).first()["formatted"] == "<|im_start|>user\nhi <| there<|im_end|>\n"


def test_ties_nulls_and_no_rows(spark):
    rows = [(None, 1, "user", "a"), (1, None, "user", "first"), (1, 2, "user", "z"), (1, 2, "assistant", "y"), (1, 2, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat_format.format_chats(df).collect()}
    assert got == {None: ["a"], 1: ["first", "y", "y", "z"]}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_text_and_native_plan(spark, capsys):
    df = spark.createDataFrame([(1, 0, "assistant", "<|" * 50_000)], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    loss = chats.select(F.sha2(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")), 256)).first()[0]
    assert loss == hashlib.sha256(b"<|" * 50_000).hexdigest()
    chats.explain()
    assert "Python" not in capsys.readouterr().out
