"""Axis-aligned bounds of clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def position_bounds(points: DataFrame) -> DataFrame:
    """cloud_id, n, and min_/max_ of x, y and z: one aggregation with map-side partials."""
    return points.groupBy("cloud_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))))


def colour_bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("cloud_id").agg(*(f(c).alias(f"{name}_{c}") for c in "rgb" for name, f in (("min", F.min), ("max", F.max))))


def splat_bounds(splats: DataFrame) -> DataFrame:
    """Count, centre and half extent."""
    b = position_bounds(splats)
    half = lambda c, sign: ((F.col(f"max_{c}").cast("double") + F.lit(float(sign)) * F.col(f"min_{c}").cast("double")) * F.lit(0.5)).cast("float")
    return b.select("cloud_id", "n", *(half(c, 1).alias(f"centre_{c}") for c in "xyz"), *(half(c, -1).alias(f"extent_{c}") for c in "xyz"))


def with_bounds(points: DataFrame, colours: bool = False) -> DataFrame:
    """Points beside the bounds of their cloud. The bounds are one row per cloud; Spark broadcasts them when they are small."""
    out = points.join(position_bounds(points), "cloud_id")
    return out.join(colour_bounds(points), "cloud_id") if colours else out
