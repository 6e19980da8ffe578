import numpy as np
import pytest

from cloudloom.llm import annsearch as A


def brute(ids, x, every, k):
    out = {}
    for i in sorted({i for i in ids if i % every == 0}):
        q = x[ids.index(i)]
        score = [(-float(q @ v), j) for j, v in zip(ids, x, strict=True) if j != i]
        out[i] = sorted(score)[:k]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(A, "SAMPLE", 1500)
    monkeypatch.setattr(A, "LEAF_ROWS", 80)
    monkeypatch.setattr(A, "PIECE", 64)
    monkeypatch.setattr(A, "QUERIES", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got, want = result(A.search(df)), brute(ids, x.astype(np.float64), 20, 20)
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (20 * len(want)) > 0.9
    for i, rows in got.items():
        assert rows == sorted(rows)
        assert all(abs(-s - float(x[i].astype(float) @ x[j].astype(float))) < 1e-12 for s, j in rows)


def test_few_vectors_ties_and_bad_ones(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.5, 0.5], "b"), (2, [0.5, 0.5], None), (20, [0.0, 1.0], "d"), (3, None, "e"), (4, [0.0, 0.0], "f"), (5, [float("nan"), 1.0], "g"), (6, [float("inf"), 1.0], "h"), (7, [None, 1.0], "i"), (8, [1.0], "j"), (None, [1.0, 1.0], "k"), (40, None, "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = result(A.search(df))
    assert got == {0: [(-0.5, 1), (-0.5, 2), (0.0, 20)], 20: [(-0.5, 1), (-0.5, 2), (0.0, 0)]}
    assert A.search(df.where("false")).count() == 0
    # vectors of another dimension are compared with one another
    more = [(60, [2.0, 0.0, 1.0], "m"), (9, [1.0, 0.0, 0.5], "n"), (100, [1.0] * 5, "o"), (80, [], "p")]
    both = result(A.search(df.union(spark.createDataFrame(more, df.schema))))
    assert both == got | {60: [(-2.5, 9)]}
    assert A.search(df.where("vec_id in (1, 2)")).count() == 0


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 50)
    df = spark.range(400).selectExpr("id as vec_id", "array(1.0f, 2.0f, 3.0f) as embedding")
    got = result(A.search(df))
    for i, rows in got.items():
        assert [j for _, j in rows] == [j for j in range(21) if j != i][:20]


@pytest.mark.parametrize("reach", [0.0, 0.4])
def test_traversal_visits_all_leaves_once(reach):
    x = np.random.default_rng(1).normal(size=(2000, 8))
    tree = A.fit(x, leaf=30)
    order = A.visits(tree, x[0], tree.leaves, reach)
    assert sorted(order) == list(range(tree.leaves)) and set(np.unique(A.assign(tree, x))) <= set(order)


def test_small_leaves_are_widened():
    """Leaves of few rows: the traversal goes on until enough rows are in the visited ones, or all are visited."""
    x = np.random.default_rng(3).normal(size=(400, 4))
    tree = A.fit(x, leaf=10)
    sizes = np.ones(tree.leaves, np.int64)
    assert len(A.visits(tree, x[0], 2, 0.0)) == 2
    got = A.visits(tree, x[0], 2, 0.0, sizes, 21)
    assert len(got) == 21 and got == A.visits(tree, x[0], 21, 0.0)
    assert len(A.visits(tree, x[0], 2, 0.0, sizes, 10**6)) == tree.leaves and len(A.visits(tree, x[0], 2, 0.0, sizes * 30, 21)) == 2


def test_recall_on_embeddings(spark, monkeypatch):
    """The table's own vectors, with leaves so small that not all are visited; scores are the same in any batch."""
    monkeypatch.setattr(A, "LEAF_ROWS", 40)
    monkeypatch.setattr(A, "CALIBRATION", 30)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    want = brute(ids, x, 20, 20)
    got = result(A.search(df))
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (20 * len(want)) >= 0.9
    place = {i: n for n, i in enumerate(ids)}
    assert all(-s == (x[place[j]] * x[place[i]]).sum() for i, found in got.items() for s, j in found)
