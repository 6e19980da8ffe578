import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cloudloom.llm import neardup as N
from cloudloom.llm.components import components
from cloudloom.llm.storage import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = sorted((find(a), find(b)))
                root[b2] = a2
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None)


def near_copies(n, seed=0):
    """Groups whose similarities lie on both sides of the threshold, chains among them, copies, and short texts."""
    rng, out = random.Random(seed), []
    for g in range(n):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(120)]
        text = base[:]
        for _ in range(rng.randint(1, 9)):
            text = text[:] if rng.random() < 0.6 else base[:]
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    out += ["a b", "a  b", "A\tB", "a", "b", "", None, "the same short text again", "the same short text again"]
    rng.shuffle(out)
    return [(1000 - i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = near_copies(25, seed)
    got = N.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert result(got) == brute(rows)


def test_large_group(spark):
    """One group of many near copies around the threshold: several components may share its buckets."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        t = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            t[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert result(N.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark, weird, nothing):
    assert N.groups(nothing).count() == 0
    rows = N.groups(weird.withColumnRenamed("source", "kept")).collect()
    assert len(rows) == weird.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 1 and not by[6].kept and by[None].component_id is None and by[None].kept
    assert all(by[d].n_shingles == 0 and by[d].component_id == d for d in (2, 3, 4)) and by[5].n_shingles == 1
    left = N.deduplicate(weird)
    assert left.columns == weird.columns and left.where("doc_id = 6").count() == 0 and left.count() == weird.count() - 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_sketches_estimate():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.85, 0.95):
        n = 600
        common = int(2 * n * j / (1 + j))
        h = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n : 2 * n - common]]))
        m = np.stack([N.samples(a), N.samples(b)])
        assert abs((m[0] == m[1]).mean() - j) < 0.12
        odd = int(np.bitwise_count((lambda s: s[0] ^ s[1])(N.odd_sketches(m).view(np.uint64))).sum())
        fine = int(np.bitwise_count((lambda s: s[0] ^ s[1])(N.fine_sketches([a, b]).view(np.uint64))).sum())
        if j == 0.95:
            assert odd <= N.most_ones() and fine <= N.most_fine_ones(np.array(2 * n))
        if j == 0.5:
            assert odd > N.most_ones() and fine > N.most_fine_ones(np.array(2 * n))


def test_words_with_equal_polynomials(spark):
    """Words that every polynomial hash modulo 2^64 takes for one another make other sets."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(3, one), (4, other), (5, one + " " + other), (6, other + " " + one), (7, one), (8, " ".join([one] * 9)), (9, " ".join([other] * 9))]
    assert result(N.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_sets_are_compared_by_words():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    x, y = texts, [" ".join(t.split()[rng.randrange(3) :] + ["w0"] * rng.randrange(3)) for t in texts]
    for p in (5, 50, 80):
        want = [100 * len(shingles(a) & shingles(b)) >= p * len(shingles(a) | shingles(b)) for a, b in zip(x, y, strict=True)]
        assert N.reaches(pa.array(x).cast(pa.binary()), pa.array(y).cast(pa.binary()), p).tolist() == want and (True in want) and (False in want)


def test_bands_suit_the_threshold():
    assert N.bands_for(85) == N.BANDS and N.bands_for(80) == 44
    assert all((1 - (p / 100) ** N.ROWS) ** N.bands_for(p) < 2e-6 for p in (50, 80, 85, 95, 99))


def test_stage_links_from_80_on(spark):
    """The pipeline's stage against a brute force at 80; pairs lie at 0.77, 0.8 exactly, 0.84 and 0.92."""
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(120 if g % 2 else 49)]
        text = base[:]
        for k in range(1 + g % 3 if g % 2 else 1):
            text[20 + 20 * k] = "other"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(text))]
    sets = [(d, shingles(t)) for d, t in rows]
    close = lambda x, y, p: 100 * len(x & y) >= p * len(x | y)
    gone = lambda p: {b for (_, x), (b, y) in zip(sets[::2], sets[1::2], strict=True) if close(x, y, p)}
    assert gone(80) > gone(85)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert left == {d for d, _ in rows} - gone(80)
