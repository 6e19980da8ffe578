"""Exact nearest neighbours by grid cells, without comparing all pairs of a large cloud.

Clouds of at most SMALL pairs are compared in one group, in blocks. For the others references are put into cubic cells; a query looks into the 27
cells around its own. A neighbour that is no farther than one cell's side can't be beaten from outside, so it is final. Queries without enough
such neighbours go on with cells of four times the side, until a side exceeds the whole cloud. Every round is an equi-join on the cell, which
AQE may split; of equal positions only as many references are kept as can be among the nearest, so a pile of copies isn't a hot cell. The first
side follows from the cloud's extent: one far outlier makes cells that hold most of a large cloud, and the work grows with their square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounds import position_bounds

#: References that a cell should hold on average.
PER_CELL = 4.0
#: Pairs of a cloud that are compared at once.
SMALL = 1 << 24
#: Larger sides at once after the first rounds: outliers are found in few rounds.
GROWTH = 4.0


def distance2(a: str, b: str) -> Column:
    """Squared distance of columns <a>x.. and <b>x.., in double precision."""
    d = [F.col(f"{a}{c}").cast("double") - F.col(f"{b}{c}").cast("double") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _cells(df: DataFrame, prefix: str) -> list[Column]:
    return [F.floor((F.col(f"{prefix}{c}").cast("double") - F.col(f"lo_{c}")) / F.col("side")).cast("long").alias(f"c{c}") for c in "xyz"]


def nearest(test: DataFrame, ref: DataFrame, k: int = 1) -> DataFrame:
    """cloud_id, idx, rank (from 1), ref_idx and d2: the k nearest references of every test point, ties to smaller ref_idx.

    A cloud without references gives no rows; with fewer than k, all of them. Points and references with null or non-finite
    positions take no part.
    """
    fine = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz")
    test, ref = test.where(fine), ref.where(fine)
    sizes = test.groupBy("cloud_id").agg(F.count("*").alias("n")).join(ref.groupBy("cloud_id").agg(F.count("*").alias("m")), "cloud_id").persist()
    large = sizes.where(f"n * m > {SMALL}").select("cloud_id")
    if large.isEmpty():
        sizes.unpersist()
        return _in_groups(test, ref, k)
    small = _in_groups(test.join(large, "cloud_id", "left_anti"), ref.join(large, "cloud_id", "left_anti"), k)
    return small.unionByName(_by_cells(test.join(large, "cloud_id", "left_semi"), ref.join(large, "cloud_id", "left_semi"), k))


def _in_groups(test: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """All pairs of each cloud, some queries at a time; only for clouds of a checked size."""

    def run(both: pa.Table) -> pa.Table:
        mine = both["mine"].to_numpy()
        t, r = both.filter(pa.array(mine)), both.filter(pa.array(~mine))
        out = {"cloud_id": [], "idx": [], "rank": [], "ref_idx": [], "d2": []}
        order = np.argsort(r["idx"].to_numpy(), kind="stable")
        ids = r["idx"].to_numpy()[order]
        q, x = (np.stack([a[c].to_numpy().astype(np.float64) for c in "xyz"], axis=1) for a in (t, r))
        x, most = x[order], min(k, len(ids))
        step = max(1, (1 << 20) // max(len(ids), 1))
        for i in range(0, len(q) if most else 0, step):
            d = [q[i : i + step, None, c] - x[None, :, c] for c in range(3)]
            d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            near = d2.argmin(axis=1)[:, None] if most == 1 else np.argsort(d2, axis=1, kind="stable")[:, :most]
            n = len(near)
            out["cloud_id"].append(np.repeat(np.arange(i, i + n), most))
            out["idx"].append(np.repeat(t["idx"].to_numpy()[i : i + n], most))
            out["rank"].append(np.tile(np.arange(1, most + 1), n))
            out["ref_idx"].append(ids[near].ravel())
            out["d2"].append(np.take_along_axis(d2, near, axis=1).ravel())
        flat = {n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()}
        return pa.table([t["cloud_id"].take(pa.array(flat["cloud_id"].astype(np.int64))), pa.array(flat["idx"], pa.int64()), pa.array(flat["rank"], pa.int32()), pa.array(flat["ref_idx"], pa.int64()), pa.array(flat["d2"], pa.float64())], names=list(out))

    kind = test.schema["cloud_id"].dataType.simpleString()
    sides = [df.select("cloud_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", F.lit(mine).alias("mine")) for df, mine in ((test, True), (ref, False))]
    return sides[0].union(sides[1]).groupBy("cloud_id").applyInArrow(run, f"cloud_id {kind}, idx long, rank int, ref_idx long, d2 double")


def _by_cells(test: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    q = test.select("cloud_id", F.col("idx"), *(F.col(c).alias(f"q{c}") for c in "xyz"))
    r = ref.select("cloud_id", F.col("idx").alias("ref_idx"), *(F.col(c).alias(f"r{c}") for c in "xyz"))
    if k == 1:
        r = r.groupBy("cloud_id", "rx", "ry", "rz").agg(F.min("ref_idx").alias("ref_idx"))
    else:
        same = Window.partitionBy("cloud_id", "rx", "ry", "rz").orderBy("ref_idx")
        r = r.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k).drop("copy")
    r = r.persist()
    both = test.select("cloud_id", "x", "y", "z").union(ref.select("cloud_id", "x", "y", "z"))
    counts = ref.groupBy("cloud_id").agg(F.count("*").alias("m"))
    size = position_bounds(both).join(counts, "cloud_id")
    span = F.greatest(*(F.col(f"max_{c}").cast("double") - F.col(f"min_{c}").cast("double") for c in "xyz"), F.lit(1e-30))
    side = span / F.greatest(F.lit(1.0), F.pow(F.col("m") / (PER_CELL * max(1, k)), F.lit(1 / 3)))
    size = size.select("cloud_id", "m", span.alias("span"), side.alias("side"), *(F.col(f"min_{c}").cast("double").alias(f"lo_{c}") for c in "xyz")).persist()
    out, scale, todo = [], 1.0, q
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("abc", s, strict=True))) for s in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    last = Window.partitionBy("cloud_id", "idx").orderBy("d2", "ref_idx")
    while True:
        sized = size.withColumn("side", F.col("side") * F.lit(scale))
        cells = r.join(sized, "cloud_id").select("cloud_id", "ref_idx", "rx", "ry", "rz", *_cells(r, "r"))
        asked = todo.join(sized, "cloud_id").select("cloud_id", "idx", "qx", "qy", "qz", "m", "span", "side", *_cells(todo, "q"))
        asked = asked.select("*", F.explode(steps).alias("s")).withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"s.{n}") for c, n in zip("xyz", "abc", strict=True)})
        pairs = asked.join(cells, ["cloud_id", "cx", "cy", "cz"]).select("cloud_id", "idx", "ref_idx", "m", "span", "side", distance2("q", "r").alias("d2"))
        if k == 1:
            best = pairs.groupBy("cloud_id", "idx").agg(F.min(F.struct("d2", "ref_idx")).alias("b"), F.first("side").alias("side"), F.first("span").alias("span"))
            best = best.select("cloud_id", "idx", F.lit(1).alias("rank"), "b.ref_idx", "b.d2", (F.sqrt("b.d2") <= F.col("side")).alias("sure"), (F.col("side") > F.col("span")).alias("whole"))
        else:
            best = pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            all_ = Window.partitionBy("cloud_id", "idx")
            full = (F.max("rank").over(all_) >= F.least(F.lit(k).cast("long"), F.col("m"))) & (F.max(F.sqrt("d2")).over(all_) <= F.col("side"))
            best = best.select("cloud_id", "idx", "rank", "ref_idx", "d2", full.alias("sure"), (F.col("side") > F.col("span")).alias("whole"))
        best = best.persist()
        done = best.where("sure or whole").select("cloud_id", "idx", "rank", "ref_idx", "d2")
        out.append(done)
        left = todo.join(done.select("cloud_id", "idx").distinct(), ["cloud_id", "idx"], "left_anti").join(size.select("cloud_id"), "cloud_id", "left_semi").persist()
        if left.isEmpty():
            break
        todo, scale = left, scale * GROWTH
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def axis_ties(points: DataFrame) -> DataFrame:
    """Per cloud, how often the most frequent coordinate of any axis occurs."""
    each = points.select("cloud_id", F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(c).alias("v")) for i, c in enumerate("xyz")))).alias("a"))
    return each.groupBy("cloud_id", "a.axis", "a.v").agg(F.count("*").alias("n")).groupBy("cloud_id").agg(F.max("n").alias("max_ties"))


def bucket_size(max_ties: Column) -> Column:
    """The step of a fixed ladder that holds the ties; 0 beyond it, where only a scan is left."""
    out = F.when(max_ties <= 32, 32)
    for step in (128, 512, 1024, 2048, 8192):
        out = out.when(max_ties <= step, step)
    return out.otherwise(0)
