import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tenderloom.llm import byte_bpe
from tenderloom.llm.queries import op1_byte_bpe, vocabulary_bytes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.Vocabulary.parse(vocabulary_bytes())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(vocab, text):
    import regex

    coded = vocab.encode_block([regex.findall(public_tokenizers.PATTERN, text)])[0]
    return np.frombuffer(coded, "<u4").tolist(), coded


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(vocab, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    got, coded = ids(vocab, text)
    assert got == reference.encode_ordinary(text)
    assert vocab.decode(coded) == text.encode()


def test_long_pieces(vocab, reference):
    for text in ("a" * 5000, "ab" * 700 + " " * 900 + "é" * 600, "x" * 511 + "y" * 513):
        assert ids(vocab, text)[0] == reference.encode_ordinary(text)


def test_table(spark, docs, none, reference):
    data = vocabulary_bytes()
    coded = byte_bpe.encode(docs, data, public_tokenizers.PATTERN, keep=("doc_id", "text", "score"))
    for r in byte_bpe.decode(coded, data, keep=("text", "ids", "n_tokens")).collect():
        want = reference.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(none, data, public_tokenizers.PATTERN).count() == 0


def test_query(spark, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        want = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
