import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudloom.llm import textops as X

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB\u00e4\u65e5\U0001f642 \t\n\x0b\r-.9", max_size=40)), min_size=1, max_size=6)


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_words_are_the_patterns_words(texts):
    for table, pattern, lower in ((X.SPACE, r"[^\x20\x09-\x0D]+", False), (X.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        data, offs = X.raw(pa.array(texts, pa.string()))
        w = X.words(data, offs, table, lower)
        low = X.LOWER[data] if lower else data
        mine = [[bytes(low[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
        plain = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or "") for t in texts]
        assert mine == plain
        flat = [x for row in plain for x in row]
        assert all((w.hashes[i] == w.hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@given(TEXT, st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_shingles_stay_in_their_row(texts, k):
    data, offs = X.raw(pa.array(texts, pa.string()))
    w = X.words(data, offs, X.SPACE)
    h, at, ptr = X.grams(w.hashes, w.ptr, k)
    rows = [(t or "").split() for t in texts]
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [tuple(r[i : i + k]) for r in rows for i in range(max(0, len(r) - k + 1))]
    assert len(h) == len(flat) == ptr[-1]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_long_texts_go_in_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(4000))
    data, offs = X.raw(pa.array([text]))
    whole = X.words(data, offs, X.SPACE)
    g = X.grams(whole.hashes, whole.ptr, 5)[0]
    monkeypatch.setattr(X, "BLOCK_BYTES", 512)
    again = X.words(data, offs, X.SPACE)
    assert (whole.hashes == again.hashes).all() and (X.grams(again.hashes, again.ptr, 5)[0] == g).all()
    assert len(list(X.blocks(pa.array(["a" * 300] * 5), 512))) == 5
    assert np.concatenate([d for _, _, d, _ in X.blocks(pa.array(["ab", None, "c" * 900, "d"]), 512)]).tobytes() == b"ab" + b"c" * 900 + b"d"
