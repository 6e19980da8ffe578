"""Frames of point clouds as a stream: new payload files are decoded as they arrive, and can be summed up by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import payloads
from ..sources.files import EXTENSIONS

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_frames(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """(cloud_id, at, payload) of files that appear below a path."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").option("maxFilesPerTrigger", per_batch).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return stream.select(name.alias("cloud_id"), F.col("modificationTime").alias("at"), F.col("content").alias("payload"))


def read_points(spark: SparkSession, path: str, target: str = "points", per_batch: int = 100) -> DataFrame:
    return payloads.decode(read_frames(spark, path, per_batch), target)


def traffic(frames: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Frames, bytes and formats by time window; what arrives later than the watermark is left out."""
    kinds = frames.withColumn("format", payloads.format_of(F.col("payload"))).withWatermark("at", late)
    return kinds.groupBy(F.window("at", window).alias("window"), "format").agg(F.count("*").alias("frames"), F.sum(F.length("payload")).alias("bytes"))
