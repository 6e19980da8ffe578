"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

1. The tree is fitted on a bounded sample: every node with enough vectors is split into BRANCHES clusters; leaves are bins. There are as many as
   the table has LEAF_ROWS rows, until a leaf has LEAST rows of the sample only.
2. Every row is indexed: it descends to the leaf of the nearest centroid at each level. No row is left out.
3. A query traverses the tree best bin first: a priority queue holds nodes by the inner product of query and centroid (plus the node's radius
   in the query's direction, as far as calibration found useful); the best is opened, until enough leaves have been visited.
4. How many is calibrated: for some queries the true neighbours among all rows are found by a scan in blocks, the leaves that hold them are
   known, and visits are widened until the wanted recall is reached. As many other queries tell what recall that gives (it is logged).
5. Rows and queries of a leaf meet in pieces of bounded size, and each piece gives each of its queries its best candidates.

Nearness is the inner product of the original vectors in double precision, summed in one order whatever else is in a batch; ties go to the
smaller id. It is defined for vectors of one dimension: the tree holds those of the commonest, and the vectors of each other dimension are one
leaf of their own, which its queries visit whole.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: The tree is fitted on at most this many rows.
SAMPLE = 40_000
BRANCHES = 8
#: Rows of the table for each leaf, and the fewest rows of the sample in a leaf that is split.
LEAF_ROWS, LEAST = 1024, 32
#: Queries that are compared with all rows for calibration (and as many again to judge it), and the recall that visits are widened to.
CALIBRATION, RECALL = 128, 0.96
#: Rows and queries of a leaf that meet in one task.
PIECE, QUERIES = 4096, 4096


@dataclass
class Tree:
    centroids: np.ndarray  # (nodes, d)
    radius: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # number of the leaf, or -1
    leaves: int


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster numbers after some rounds; clusters may stay empty."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(12):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        for j in range(k):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
            else:  # an empty cluster starts again at the vector that is served worst
                c[j] = x[((x - c[near]) ** 2).sum(1).argmax()]
    return (x @ c.T - (c * c).sum(1) / 2).argmax(1)


def fit(x: np.ndarray, leaf: int, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centroids, radius, children, leaves = [], [], [], []

    def grow(rows: np.ndarray) -> int:
        own = x[rows]
        me = len(centroids)
        c = own.mean(0) if len(own) else np.zeros(x.shape[1])
        centroids.append(c)
        radius.append(float(np.sqrt(((own - c) ** 2).sum(1)).mean()) if len(own) else 0.0)
        children.append([])
        leaves.append(-1)
        parts = []
        if len(rows) > leaf and (own != own[0]).any():
            near = _kmeans(own, min(BRANCHES, -(-2 * len(rows) // leaf)), rng)
            parts = [rows[near == j] for j in np.unique(near)]
        if len(parts) > 1:
            children[me] = [grow(p) for p in parts]
        return me

    grow(np.arange(len(x)))
    number = 0
    for i, below in enumerate(children):
        if not below:
            leaves[i] = number
            number += 1
    return Tree(np.array(centroids).reshape(len(centroids), x.shape[1]), np.array(radius), children, np.array(leaves), number)


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every vector."""
    at = np.zeros(len(x), np.int64)
    while True:
        moved = False
        for node in np.unique(at):
            if below := tree.children[node]:
                rows = np.flatnonzero(at == node)
                c = tree.centroids[below]
                at[rows] = np.array(below)[(x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)]
                moved = True
        if not moved:
            return tree.leaf[at]


def visits(tree: Tree, q: np.ndarray, most: int, reach: float, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
    """The first ``most`` leaves of a best-bin-first traversal; with the rows per leaf, more until ``least`` rows are in them."""
    gain = tree.centroids @ q + reach * float(np.sqrt(q @ q)) * tree.radius
    queue, out, held = [(-gain[0], 0)], [], 0
    while queue and (len(out) < most or (sizes is not None and held < least)):
        _, node = heapq.heappop(queue)
        if not tree.children[node]:
            out.append(int(tree.leaf[node]))
            held += 0 if sizes is None else int(sizes[out[-1]])
        for child in tree.children[node]:
            heapq.heappush(queue, (-gain[child], child))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _top(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (vectors q, ids own), the best k (ids, scores) of the rows (vectors x) without its own id; ties to smaller ids.

    A matrix product proposes; the scores of what may be among the best are summed again, one row at a time.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    slack = 1e-12 * x.shape[1] * np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((q * q).sum(1))
    for v, row, me, near in zip(q, q @ x.T, own, slack, strict=True):
        row = np.where(ids == me, -np.inf, row)
        least = np.partition(row, len(row) - k)[len(row) - k] - near if len(row) > k else -np.inf
        some = np.flatnonzero((row >= least) & (row > -np.inf))
        score = (x[some] * v).sum(axis=1)
        best = np.argsort(-score, kind="stable")[:k]
        yield ids[some[best]], score[best]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of rows that take part: with an id, finite and not zero."""
    plain = vectors.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector) if plain else F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def search(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each row whose id is divisible by ``every``, the k nearest other rows that are found.

    Rows with a null id, or a vector that is null, zero (or empty), or holds null or non-finite components, take no part. Candidates have their
    query's dimension. Other columns are not read. Rows that repeat an id are candidates each, but are one query, and no row with the query's own id is a candidate. An empty table
    gives an empty result.
    """
    s = Scratch(vectors.sparkSession)
    rows = s.settle(usable(vectors, key, vector), "vectors")
    context = vectors.sparkSession.sparkContext
    out = "query_id long, rank int, vec_id long, score double"
    kind = rows.schema["v"].dataType.simpleString()
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    d, n = sizes[0].d, sizes[0]["count"]
    main = rows.where(F.size("v") == d)
    # a share of the rows by hash, so that a few more than the sample are sorted, and not all of every partition
    share = int(min(1.0, 1.2 * SAMPLE / n) * (1 << 30))
    drawn = main.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share)
    some = drawn.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    if not len(some):
        some = main.limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    tree = fit(_matrix(some), max(LEAST, LEAF_ROWS * len(some) // n))
    shared = context.broadcast(tree)  # bounded as the sample is

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            leaf, own = -size.astype(np.int64), size == d
            leaf[own] = assign(shared.value, _matrix(batch.column(1).filter(pa.array(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=["id", "v", "leaf"])

    indexed = s.settle(rows.mapInArrow(index, f"id long, v {kind}, leaf long"), "index")
    queries = indexed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    most, reach = calibrate(indexed.where("leaf >= 0"), queries.where(F.size("v") == d), tree, k, recall)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.where("leaf >= 0").groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf
        sizes[r.leaf] = r.n
    held = context.broadcast(sizes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # k rows besides those of the query's own id
            vectors = [np.asarray(q.values, np.float64) for q in batch.column(1)]
            found = [visits(shared.value, q, most, reach, held.value, k + own) if len(q) == d else [-len(q)] for q, own in zip(vectors, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["id", "v", "leaves"])

    routed = s.settle(queries.mapInArrow(route, f"id long, v {kind}, leaves array<long>"), "queries")
    routed = routed.select("id", "v", F.explode("leaves").alias("leaf"))
    # one row per leaf: a table as bounded as the tree
    pieces = indexed.groupBy("leaf").agg(F.count("*").alias("n"))
    asked = routed.groupBy("leaf").agg(F.count("*").alias("m"))
    counts = pieces.join(asked, "leaf").select("leaf", F.ceil(F.col("n") / PIECE).alias("n"), F.ceil(F.col("m") / QUERIES).alias("m"))
    counts = F.broadcast(s.settle(counts, "counts"))
    dealt = lambda own, other: (F.pmod(F.xxhash64("id"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
    left = indexed.join(counts, "leaf").select("leaf", "id", "v", *dealt("n", "m"))
    right = routed.join(counts, "leaf").select("leaf", "id", "v", *dealt("m", "n"))

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, x = mine["id"].to_numpy(), _matrix(mine["v"].combine_chunks())
        own, q = theirs["id"].to_numpy(), _matrix(theirs["v"].combine_chunks())
        found_ids, found_scores = [], []
        if len(ids):
            for i in range(0, len(own), 256):
                for a, b in _top(q[i : i + 256], own[i : i + 256], x, ids, k):
                    found_ids.append(a)
                    found_scores.append(b)
        n = len(found_ids)
        return pa.table({"query_id": pa.array(own[:n], pa.int64()), "ids": pa.array(found_ids, pa.list_(pa.int64())), "scores": pa.array(found_scores, pa.list_(pa.float64()))})

    met = left.groupBy("leaf", "n", "m").cogroup(right.groupBy("leaf", "n", "m")).applyInArrow(meet, "query_id long, ids array<long>, scores array<double>")
    listed = met.select("query_id", F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("far"), x["ids"].alias("vec_id"))).alias("found"))
    best = listed.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    best = best.select("query_id", F.posexplode("found").alias("at", "x"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def exact(indexed: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> dict[int, list[tuple[float, int, int]]]:
    """(score, id, leaf) of the true k nearest of some queries, by a scan of all rows in blocks."""
    own, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries])
    shared = indexed.sparkSession.sparkContext.broadcast((own, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best: list[list[tuple[float, int, int]]] = [[] for _ in own]
        for batch in batches:
            for lo in range(0, len(batch), 8192):
                part = batch.slice(lo, 8192)
                ids, leaf = part.column(0).to_numpy(), part.column(2).to_numpy()
                where = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
                for i, (a, b) in enumerate(_top(q, own, _matrix(part.column(1)), ids, k)):
                    best[i] = sorted([*best[i], *((-float(y), int(x), where[int(x)]) for x, y in zip(a, b, strict=True))])[:k]
        flat = [(int(own[i]), x, y, z) for i, rows in enumerate(best) for y, x, z in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query", "id", "far", "leaf"])

    out: dict[int, list[tuple[float, int, int]]] = {int(i): [] for i in own}
    found = indexed.mapInArrow(scan, "query long, id long, far double, leaf long")
    for r in found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id", "leaf"))), 1, k).alias("x")).collect():
        out[r.query] = [(y.far, y.id, y.leaf) for y in r.x]
    return out


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit, and the weight of the radius, that reach the recall on the calibration queries with the fewest visits."""
    drawn = [(r.id, r.v) for r in queries.orderBy(F.xxhash64("id"), "id").limit(2 * CALIBRATION).collect()]
    if not drawn:
        return tree.leaves, 0.0
    truth = exact(indexed, drawn, k)
    # of few queries all are calibrated on
    mine, others = (drawn, []) if len(drawn) < 2 * CALIBRATION else (drawn[::2], drawn[1::2])

    def ranks(some: list[tuple[int, list[float]]], reach: float) -> np.ndarray:
        """How many true neighbours are in the first, second, ... visited leaf."""
        places = np.zeros(tree.leaves + 1)
        for i, v in some:
            order = {leaf: n for n, leaf in enumerate(visits(tree, np.array(v, np.float64), tree.leaves, reach))}
            for _, _, leaf in truth[i]:
                places[order[leaf]] += 1
        return places

    best = (tree.leaves, 0.0)
    for reach in (0.0, 0.1, 0.2, 0.4):
        places = ranks(mine, reach)
        enough = int(np.searchsorted(np.cumsum(places), recall * places.sum())) + 1
        best = min(best, (min(enough, tree.leaves), reach))
    if others:
        places = ranks(others, best[1])
        logging.getLogger(__name__).info("%d of %d leaves are visited: recall %.3f on other queries", best[0], tree.leaves, places[: best[0]].sum() / max(places.sum(), 1))
    return best
