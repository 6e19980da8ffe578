"""Files to files: decode, sample, chunk, encode and write, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..operators import chunking, sampling
from ..sources import files, payloads


def choose_chunks(points: DataFrame, grid: tuple[int, int, int] | None = None, tile: float | None = None, percentages: list[int] | None = None, regions: list[tuple[float, ...]] | None = None, keep_rest: bool = True) -> DataFrame:
    """At most one way of chunking; each chunk becomes a cloud of its own."""
    if sum(x is not None for x in (grid, tile, percentages, regions)) > 1:
        raise ValueError("only one way of chunking at a time")
    if grid is not None:
        return chunking.as_clouds(chunking.grid(points, *grid), ["chunk_x", "chunk_y", "chunk_z"])
    if tile is not None:
        return chunking.as_clouds(chunking.tiles(points, tile), ["chunk_x", "chunk_y", "chunk_z"])
    if percentages is not None:
        return chunking.as_clouds(chunking.percentages(points, percentages), ["chunk"])
    if regions is not None:
        return chunking.as_clouds(chunking.regions(points, regions, keep_rest), ["chunk"])
    return points


def transcode(spark: SparkSession, source: str, target: str, params: P.Params, kind: str = "points", count: int | None = None, extensions: tuple[str, ...] | None = None, recursive: bool = False, overwrite: bool = False, **chunks) -> None:
    """All clouds below ``source`` as files of one codec chain below ``target``."""
    P.validate(params, kind)
    points = payloads.decode(files.read_payloads(spark, source, extensions, recursive), kind)
    if count is not None:
        points = sampling.by_count(points, count)
    files.write_payloads(payloads.encode(choose_chunks(points, **chunks), params), target, overwrite)


def milliseconds(ns):
    """Nanoseconds as x.xxx ms."""
    return F.format_string("%.3f ms", ns / F.lit(1e6))
