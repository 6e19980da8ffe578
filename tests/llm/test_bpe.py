import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudloom.llm import bpe
from cloudloom.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    path, pattern = vocabulary()
    return bpe.Codec(bpe.serialise(bpe.read_ranks(path)), pattern)


@pytest.fixture(scope="module")
def other():
    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.one_of(st.sampled_from("ab '\n\ts19\u00e9\u2581\u65e5\U0001f642<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=300, deadline=None)
def test_like_the_other_library(codec, other, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "SLICE", 7)
    text = " ".join(f"word{i} thing" for i in range(500))
    assert codec.decode(codec.encode(text)) == text.encode() and len(codec.known) <= 60


def test_table(spark, weird, nothing, other):
    got = bpe.encode_decode(weird.selectExpr("*", "1 as decoded"), *vocabulary())
    assert got.columns == ["doc_id", "text", "source", "token_ids", "decoded"]
    for r in got.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
        if r.doc_id != 9:
            assert np.frombuffer(r.token_ids, "<u4").tolist() == other.encode_ordinary(r.text or "")
    assert bpe.encode_decode(nothing, *vocabulary()).count() == 0
    assert bpe.digests(weird, *vocabulary()).where("n_tokens = 0").count() == 2
