"""Reconstruction quality: geometry and colour errors of matched points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import psnr, ycbcr
from .neighbours import nearest


def matches(test: DataFrame, ref: DataFrame) -> DataFrame:
    """cloud_id, idx, ref_idx and dist of every test point's nearest reference."""
    return nearest(test, ref).select("cloud_id", "idx", "ref_idx", F.sqrt("d2").alias("dist"))


def positional_symmetric(test: DataFrame, ref: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """Forward distance of point i averaged with the backward distance of the reference at place i modulo their number.

    This depends on places, as the measure that it reproduces does; :func:`chamfer` doesn't.
    """
    forward = matches(test, ref) if forward is None else forward
    place = Window.partitionBy("cloud_id").orderBy("idx")
    count = ref.groupBy("cloud_id").agg(F.count("*").alias("n_ref"))
    ahead = forward.select("cloud_id", "idx", "dist", (F.row_number().over(place) - 1).alias("at")).join(count, "cloud_id").withColumn("at", F.col("at") % F.col("n_ref"))
    back = matches(ref, test).select("cloud_id", F.col("dist").alias("back"), (F.row_number().over(place) - 1).alias("at"))
    return ahead.join(back.withColumn("at", F.col("at").cast("long")), ["cloud_id", "at"]).select("cloud_id", "idx", ((F.col("dist") + F.col("back")) * F.lit(0.5)).alias("dist"))


def chamfer(test: DataFrame, ref: DataFrame) -> DataFrame:
    """Mean distance both ways, and the largest: independent of the order of points."""
    sides = matches(test, ref).unionByName(matches(ref, test))
    return sides.groupBy("cloud_id").agg(F.avg("dist").alias("mean_distance"), F.max("dist").alias("hausdorff"))


def nearest_rank(df: DataFrame, value: str, percents: dict[str, float]) -> DataFrame:
    """Per cloud, elements number round(p / 100 * (n - 1)) of the sorted values, without interpolation."""
    ordered = Window.partitionBy("cloud_id").orderBy(value)
    ranked = df.select("cloud_id", F.col(value).alias("v"), (F.row_number().over(ordered) - 1).alias("at"), F.count("*").over(Window.partitionBy("cloud_id")).alias("n"))
    where = {name: F.floor(F.lit(p / 100.0) * (F.col("n") - 1) + F.lit(0.5)) for name, p in percents.items()}
    return ranked.groupBy("cloud_id").agg(*(F.max(F.when(F.col("at") == at, F.col("v"))).alias(name) for name, at in where.items()))


def rmse(v: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(v * v)), F.lit(0.0))


def distance_metrics(distances: DataFrame, prefix: str = "d1") -> DataFrame:
    """rmse, median and 95 % of the column dist."""
    ranks = nearest_rank(distances, "dist", {f"{prefix}_median": 50.0, f"{prefix}_p95": 95.0})
    return distances.groupBy("cloud_id").agg(rmse(F.col("dist")).alias(f"{prefix}_rmse")).join(ranks, "cloud_id")


def outliers_beyond(distances: DataFrame, limit: float) -> DataFrame:
    return distances.groupBy("cloud_id").agg(F.avg(F.when(F.col("dist") > F.lit(limit), F.lit(1.0)).otherwise(F.lit(0.0))).alias("outlier_ratio"))


def outliers_mad3(distances: DataFrame) -> DataFrame:
    """The share beyond median + 3 * median absolute deviation, both by nearest rank."""
    off = distances.join(nearest_rank(distances, "dist", {"median": 50.0}), "cloud_id").withColumn("off", F.abs(F.col("dist") - F.col("median")))
    limits = off.join(nearest_rank(off, "off", {"mad": 50.0}), "cloud_id")
    beyond = F.col("dist") > F.col("median") + F.lit(3.0) * F.col("mad")
    return limits.groupBy("cloud_id").agg(F.avg(F.when(beyond, F.lit(1.0)).otherwise(F.lit(0.0))).alias("outlier_ratio"))


def colour_metrics(test: DataFrame, ref: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Mean squared errors of Y, Cb and Cr over matched points, and their PSNR."""
    pairs = matches(test, ref) if pairs is None else pairs
    side = lambda df, key, p: df.select("cloud_id", F.col("idx").alias(key), *(c.alias(f"{p}{n}") for c, n in zip(ycbcr(F.col("r"), F.col("g"), F.col("b")), ("y", "cb", "cr"), strict=True)))
    joined = pairs.join(side(test, "idx", "t_"), ["cloud_id", "idx"]).join(side(ref, "ref_idx", "r_"), ["cloud_id", "ref_idx"])
    square = lambda n: (F.col(f"t_{n}") - F.col(f"r_{n}")) * (F.col(f"t_{n}") - F.col(f"r_{n}"))
    mse = joined.groupBy("cloud_id").agg(*(F.avg(square(n)).alias(f"{n}_mse") for n in ("y", "cb", "cr")))
    return mse.withColumns({f"{n}_psnr": psnr(F.col(f"{n}_mse")) for n in ("y", "cb", "cr")})


def covariances(points: DataFrame, k: int) -> DataFrame:
    """The six second moments of every point's k nearest (itself included, three at least)."""
    near = nearest(points, points, max(k, 3)).select("cloud_id", "idx", "ref_idx")
    at = points.select("cloud_id", F.col("idx").alias("ref_idx"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    grouped = near.join(at, ["cloud_id", "ref_idx"]).groupBy("cloud_id", "idx")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    # centred on the first neighbour's own coordinates by covar_pop, which is stable
    return grouped.agg(*(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))


def pca_normals(points: DataFrame, k: int = 16) -> DataFrame:
    """cloud_id, idx and the unit normal nx, ny, nz: the eigenvector of the smallest eigenvalue. Its sign is arbitrary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(i).to_numpy() for i in range(2, 8)]
            m = np.stack([np.stack([c[0], c[1], c[2]], -1), np.stack([c[1], c[3], c[4]], -1), np.stack([c[2], c[4], c[5]], -1)], -2)
            v = np.linalg.eigh(m)[1][..., 0] if len(m) else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v[:, i]) for i in range(3))], names=["cloud_id", "idx", "nx", "ny", "nz"])

    return covariances(points, k).mapInArrow(run, "cloud_id string, idx long, nx double, ny double, nz double")


def unit_normals(df: DataFrame) -> DataFrame:
    """nx, ny, nz scaled to length one; a zero vector stays."""
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return df.withColumns({c: F.when(length > 0, F.col(c) / length).otherwise(F.col(c)) for c in ("nx", "ny", "nz")})


def point_to_plane(test: DataFrame, ref: DataFrame, normals: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """cloud_id, idx and dist: how far a point is from the plane of its nearest reference."""
    pairs = matches(test, ref) if pairs is None else pairs
    t = test.select("cloud_id", "idx", *(F.col(c).cast("double").alias(f"t{c}") for c in "xyz"))
    r = ref.select("cloud_id", F.col("idx").alias("ref_idx"), *(F.col(c).cast("double").alias(f"r{c}") for c in "xyz"))
    n = normals.select("cloud_id", F.col("idx").alias("ref_idx"), "nx", "ny", "nz")
    joined = pairs.select("cloud_id", "idx", "ref_idx").join(t, ["cloud_id", "idx"]).join(r, ["cloud_id", "ref_idx"]).join(n, ["cloud_id", "ref_idx"])
    off = [(F.col(f"t{c}") - F.col(f"r{c}")) * F.col(f"n{c}") for c in "xyz"]
    return joined.select("cloud_id", "idx", F.abs(off[0] + off[1] + off[2]).alias("dist"))
