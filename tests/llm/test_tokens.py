import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import tokens

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def own():
    return tokens.encoder(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=60) | st.text("the in gat0123 é日한\n'", max_size=80))
@settings(max_examples=300, deadline=None)
def test_equals_a_reference_encoder(own, known, text):
    text = text.encode("utf-8", "replace").decode()
    assert own.encode(text) == known.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "the" * 2000, " " * 3000, "0" * 4000, "ａ" * 999, "<|endoftext|>", "\ud800x".encode("utf-8", "replace").decode()])
def test_hard_pieces(own, known, text):
    assert own.encode(text) == known.encode_ordinary(text)


def test_whole_corpus_round_trip(spark, sf, known):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = tokens.encode_texts(docs)
    want = {r.doc_id: known.encode_ordinary(r.text) if r.text else [] for r in docs.collect()}
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    texts = {r.doc_id: r.text for r in tokens.decode_ids(ids).collect()}
    assert texts == {r.doc_id: r.text or "" for r in docs.collect()}


def test_empty_and_null(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (3, " ", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in tokens.encode_texts(rows).collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert tokens.encode_texts(rows.limit(0)).count() == 0
