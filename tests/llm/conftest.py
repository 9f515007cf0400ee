import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was not amused, by any means at all!\nSecond line of the text."),
    (2, None),
    (3, ""),
    (4, "1234 !!! ###"),
    (5, "Ünïcödé 文字 \U0001f600 e\u0301 " * 40),
    (6, "a" * 3000),
    (7, "The quick brown fox jumps over the lazy dog. It was not amused, by any means at all!\nSecond line of the text."),
    (7, "the same id once more, with another text that says something else entirely"),
    (8, " \t\n  "),
    (None, "a text that has no id"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, long and repeated texts, a repeated and a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, blob string, score int").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
