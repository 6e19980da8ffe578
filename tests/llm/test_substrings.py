import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudloom.llm import substrings as S


def brute(rows, span):
    seen, out = {}, {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: (r[0], r[1] or "")):
        words = (t or "").encode().split()
        gone = set()
        for p in range(len(words) - span + 1):
            k = tuple(words[p : p + span])
            if seen.setdefault(k, (d, p)) < (d, p):
                gone.update(range(p, p + span))
        out.setdefault(d, []).append((len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return {d: sorted(v) for d, v in out.items()}


def result(df):
    out = {}
    for r in df.collect():
        if r.doc_id is not None:
            out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("span", [20, 8])
def test_against_brute_force(spark, weird, docs, span):
    extra = [(1000, "p q r " * 40, ""), (1001, " ".join(f"w{i % 37}" for i in range(700)), ""), (1002, "p q r " * 40 + "s", "")]
    both = weird.union(docs.selectExpr("doc_id + 100", "text", "source").limit(60)).union(spark.createDataFrame(extra, weird.schema))

    assert result(S.remove_repeats(both, span)) == brute([(r.doc_id, r.text) for r in both.collect()], span)


def test_one_id_with_different_texts(spark):
    """One of the texts is the document; the others stay as they are."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    got = S.remove_repeats(spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (3, b), (3, "short")], "doc_id long, text string")).collect()
    gone = sorted((r.doc_id, r.text[0], r.n_removed) for r in got)
    assert gone in ([(1, "a", 0), (1, "b", 0), (1, "b", 0), (2, "a", 30), (3, "b", 0), (3, "s", 0)], [(1, "a", 0), (1, "b", 0), (1, "b", 0), (2, "a", 0), (3, "b", 30), (3, "s", 0)],
                    [(1, "a", 0), (1, "b", 0), (1, "b", 0), (2, "a", 0), (3, "b", 0), (3, "s", 0)])


def test_edges(spark, weird, nothing):
    assert S.remove_repeats(nothing).count() == 0
    got = S.remove_repeats(weird.selectExpr("*", "'x' as n_words", "7 as removed")).collect()
    assert len(got) == weird.count() and all(r.n_removed == 0 for r in got if r.doc_id is None or r.text is None)
    assert S.remove_repeats(weird).columns == ["doc_id", "text", "source", "n_words", "n_removed", "removed", "kept_text"]


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_automaton(reference, stream, span):
    first = {}
    for p in range(len(reference) - span + 1):
        first.setdefault(tuple(reference[p : p + span]), p + span - 1)
    want = [(i, first[k]) for i in range(span - 1, len(stream)) if (k := tuple(stream[i - span + 1 : i + 1])) in first]
    assert list(S.SuffixAutomaton(reference).matches(stream, span)) == want


def test_copies_and_words_with_equal_polynomials(spark):
    """Groups of copies, copies with repeats inside, and texts that differ in a word that polynomial hashes take for another."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    base = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join([*base, one, *base[::-1]])), (2, " ".join([*base, other, *base[::-1]])), (3, " ".join([*base, other, *base[::-1]]))]
    long = " ".join(f"v{i % 611}" for i in range(1500))
    rows += [(i, long) for i in (10, 11, 12, 13)] + [(14, long + " tail"), (15, "head " + long), (20, "p q " * 30), (21, "p q " * 30), (22, "p q " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(S.remove_repeats(df)) == brute(rows, 20)
