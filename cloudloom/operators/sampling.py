"""Sampling: each choice follows from a hash of idx and a seed, so that any run and any partitioning draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1 << 32


def draw(seed: int = 0) -> Column:
    """A number in 0..2^32 - 1 for every idx."""
    h = F.pmod(F.col("idx") * F.lit(2654435761) + F.lit(seed * 40503 + 12345), F.lit(RANGE))
    return F.pmod(h * F.lit(69069) + F.shiftright(h, 16), F.lit(RANGE))


def by_rate(points: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Each point with probability ``rate``; of a cloud that would be empty, the first point (where the rate isn't 0)."""
    least = points.groupBy("cloud_id").agg(F.min(F.struct(draw(seed).alias("d"), F.col("idx"))).alias("least"))
    limit = F.lit(int(rate * RANGE))
    kept = points.withColumn("_d", draw(seed)).join(least, "cloud_id")
    alone = (F.col("least.d") >= limit) & (F.col("idx") == F.col("least.idx")) & F.lit(rate > 0)
    return kept.where((F.col("_d") < limit) | alone).select(points.columns)


def by_count(points: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Exactly min(count, n) of every cloud."""
    order = Window.partitionBy("cloud_id").orderBy(draw(seed), "idx")
    return points.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= count).select(points.columns)


def by_interest(points: DataFrame, count: int, centres: list[tuple[float, float, float]], radius: float, weight: float, seed: int = 0) -> DataFrame:
    """Exactly min(count, n) of every cloud; points within the radius of a centre weigh ``weight``, others 1.

    The largest ln(u) / w are kept, which is weighted sampling without replacement in one pass.
    """
    near = F.lit(False)
    for centre in centres:
        d = [F.col(c).cast("double") - F.lit(float(v)) for c, v in zip("xyz", centre, strict=True)]
        near = near | (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.lit(float(radius) ** 2))
    u = (draw(seed).cast("double") + F.lit(0.5)) / F.lit(float(RANGE))
    key = F.ln(u) / F.when(near, F.lit(float(weight))).otherwise(F.lit(1.0))
    order = Window.partitionBy("cloud_id").orderBy(key.desc(), "idx")
    return points.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= count).select(points.columns)


def by_percentages(points: DataFrame, percentages: list[int], seed: int = 0) -> DataFrame:
    """Adds the bucket of every point: shuffled places cut at the cumulated percentages; the last bucket takes what rounding leaves."""
    if not percentages or sum(percentages) != 100 or min(percentages) < 0:
        raise ValueError("percentages must add up to 100")
    n = F.count("*").over(Window.partitionBy("cloud_id"))
    at = F.row_number().over(Window.partitionBy("cloud_id").orderBy(draw(seed), "idx")) - 1
    out, total = F.lit(len(percentages) - 1), 0
    steps = []
    for i, p in enumerate(percentages[:-1]):
        total += p
        steps.append((i, total))
    for i, cut in reversed(steps):
        out = F.when(F.col("_at") < F.floor(F.col("_n") * cut / 100), i).otherwise(out)
    return points.withColumns({"_n": n, "_at": at}).withColumn("bucket", out).drop("_n", "_at")


def partition(points: DataFrame, percentages: list[int], pick: int, seed: int = 0) -> DataFrame:
    """One bucket of :func:`by_percentages`; numbers beyond the last mean the last."""
    pick = min(max(pick, 0), len(percentages) - 1)
    return by_percentages(points, percentages, seed).where(F.col("bucket") == pick).select(points.columns)
