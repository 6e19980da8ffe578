import hashlib
import re

import pytest

from cloudloom.llm import decontamination as D

LOW = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return LOW.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    found |= windows[k]
                    hit.update(range(j, j + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


ITEMS = [(1, "One, two three. FOUR five six seven eight nine ten eleven"), (10, "single"), (2, "and again"), (3, None), (None, "single"), (4, "..."), (5, "Z\u00fcrich wort\u00e4r"), (10, "seven eight nine"), (2, "and again")]


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_against_brute_force(spark, weird, monkeypatch, block):
    """Also with so small blocks that the benchmark takes several passes."""
    monkeypatch.setattr(D, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.mark(weird, items)
    assert result(got) == brute([(r.doc_id, r.text) for r in weird.collect()], [i for i in ITEMS if i[0] is not None and i[1] is not None])
    assert got.columns[:3] == ["doc_id", "text", "source"]


def test_on_documents(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(D.mark(docs, bench)) == brute(rows, [(r.item_id, r.text) for r in bench.collect()])


def test_empty_tables_and_clashing_columns(spark, weird, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.mark(nothing, items).count() == 0
    assert not any(r.contaminated for r in D.mark(weird, none).collect())
    clash = weird.selectExpr("*", "'x' as n_hit", "1 as items", "2 as _spans")
    got = D.mark(clash, items)
    assert dict(got.dtypes)["n_hit"] == "bigint" and got.columns.count("n_hit") == 1 and got.count() == weird.count()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_equal_polynomials(spark):
    """Words that every polynomial hash modulo 2^64 takes for one another, and windows that differ in such a word only."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, f"so {other} is here"), (4, " ".join([f"w{i}" for i in range(9)] + [other])), (5, " ".join([f"w{i}" for i in range(9)] + [one]))]
    items = [(1, one), (2, " ".join([f"w{i}" for i in range(9)] + [one]))]
    got = D.mark(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == brute(rows, items)
