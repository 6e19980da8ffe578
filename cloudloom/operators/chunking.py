"""Cutting clouds into chunks, each of which can be coded by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounds import with_bounds


def grid(points: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """Adds chunk_x, chunk_y, chunk_z: the cell of an even division of the bounds; the upper bound belongs to the last cell."""
    out = with_bounds(points)
    for c, n in zip("xyz", (nx, ny, nz), strict=True):
        lo, hi, v = (F.col(x).cast("double") for x in (f"min_{c}", f"max_{c}", c))
        cell = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * F.lit(float(n)))).otherwise(F.lit(0))
        out = out.withColumn(f"chunk_{c}", F.least(cell, F.lit(n - 1)).cast("int"))
    return out.select(*points.columns, "chunk_x", "chunk_y", "chunk_z")


def tiles(points: DataFrame, edge: float) -> DataFrame:
    """Adds chunk_x, chunk_y, chunk_z: cubes of a fixed edge from the lower bound."""
    if not 0 < edge < float("inf"):
        raise ValueError("the edge must be positive and finite")
    out = with_bounds(points)
    cells = {f"chunk_{c}": F.floor((F.col(c).cast("double") - F.col(f"min_{c}").cast("double")) / F.lit(float(edge))).cast("int") for c in "xyz"}
    return out.withColumns(cells).select(*points.columns, *cells)


def regions(points: DataFrame, boxes: list[tuple[float, ...]], keep_rest: bool = True) -> DataFrame:
    """Adds chunk: the first closed box (min x, y, z, max x, y, z) that holds the point; the rest are -1, or go."""
    for b in boxes:
        if len(b) != 6 or any(v != v or abs(v) == float("inf") for v in b) or any(b[i] > b[i + 3] for i in range(3)):
            raise ValueError(f"not a box: {b}")
    out = F.lit(-1)
    for i, b in reversed(list(enumerate(boxes))):
        inside = F.lit(True)
        for j, c in enumerate("xyz"):
            inside = inside & F.col(c).cast("double").between(F.lit(float(b[j])), F.lit(float(b[j + 3])))
        out = F.when(inside, i).otherwise(out)
    chunked = points.withColumn("chunk", out)
    return chunked if keep_rest else chunked.where("chunk >= 0")


def percentages(points: DataFrame, shares: list[int], seed: int = 0) -> DataFrame:
    """Adds chunk: shares of shuffled points."""
    from .sampling import by_percentages

    return by_percentages(points, shares, seed).withColumnRenamed("bucket", "chunk")


def as_clouds(chunked: DataFrame, columns: list[str]) -> DataFrame:
    """Each chunk as a cloud of its own; idx keeps its order."""
    name = F.concat_ws("_", "cloud_id", *(F.concat(F.lit("chunk"), F.col(c).cast("string")) for c in columns))
    return chunked.withColumn("cloud_id", name).drop(*columns)
