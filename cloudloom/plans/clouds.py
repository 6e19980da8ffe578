"""Clouds derived from the driver's tables, and the same derivations in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _u8(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * F.lit(255.0) + F.lit(128.0)))).cast("smallint")


def points_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cloud per label: positions and colours from the first six components."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("cloud_id"), F.col("vec_id").alias("idx"), *(e[i].alias(c) for i, c in enumerate("xyz")), *(_u8(e[i + 3]).alias(c) for i, c in enumerate("rgb"))
    )


def splats_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("cloud_id"), F.col("vec_id").alias("idx"), *(e[i].alias(c) for i, c in enumerate("xyz")), *(_u8(e[i + 10]).alias(c) for i, c in enumerate("rgba")),
        *(F.exp(e[i + 3].cast("double")).cast("float").alias(f"scale_{c}") for i, c in enumerate("xyz")), *(e[i + 6].alias(f"rot_{c}") for i, c in enumerate("wxyz")),
    )


def points_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cloud per return flag of the line items."""
    order = Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cloud_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.col("l_quantity").cast("float").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).cast("float").alias("y"), (F.col("l_discount") * F.lit(100.0)).cast("float").alias("z"),
        (F.col("l_partkey") % 256).cast("smallint").alias("r"), (F.col("l_suppkey") % 256).cast("smallint").alias("g"), ((F.col("l_linenumber") * 37) % 256).cast("smallint").alias("b"),
    )


def points_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small cloud per day of events."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(
        day.alias("cloud_id"), (F.row_number().over(Window.partitionBy(day).orderBy("event_id")) - 1).cast("long").alias("idx"),
        F.col("value").cast("float").alias("x"), F.col("user_id").cast("float").alias("y"), F.hour("ts").cast("float").alias("z"),
        (F.col("event_id") % 256).cast("smallint").alias("r"), (F.col("user_id") % 256).cast("smallint").alias("g"), ((F.col("event_id") * 7) % 256).cast("smallint").alias("b"),
    )


def _duck_u8(i: int) -> str:
    return f"CAST(least(255, greatest(0, floor(CAST(embedding[{i}] AS DOUBLE) * 255 + 128))) AS INTEGER)"


SQL = {
    "points_emb": "SELECT CAST(label AS VARCHAR) AS cloud_id, vec_id AS idx, "
    + ", ".join(f"embedding[{i + 1}] AS {c}" for i, c in enumerate("xyz")) + ", " + ", ".join(f"{_duck_u8(i + 4)} AS {c}" for i, c in enumerate("rgb")) + " FROM embeddings",
    "splats_emb": "SELECT CAST(label AS VARCHAR) AS cloud_id, vec_id AS idx, "
    + ", ".join(f"embedding[{i + 1}] AS {c}" for i, c in enumerate("xyz")) + ", " + ", ".join(f"{_duck_u8(i + 11)} AS {c}" for i, c in enumerate("rgba")) + ", "
    + ", ".join(f"CAST(exp(CAST(embedding[{i + 4}] AS DOUBLE)) AS FLOAT) AS scale_{c}" for i, c in enumerate("xyz")) + ", " + ", ".join(f"embedding[{i + 7}] AS rot_{c}" for i, c in enumerate("wxyz")) + " FROM embeddings",
    "points_li": "SELECT l_returnflag AS cloud_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, "
    "CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice / 1000 AS FLOAT) AS y, CAST(l_discount * 100 AS FLOAT) AS z, "
    "CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST((l_linenumber * 37) % 256 AS INTEGER) AS b FROM lineitem",
    "points_ev": "SELECT strftime(ts, '%Y-%m-%d') AS cloud_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS idx, "
    "CAST(value AS FLOAT) AS x, CAST(user_id AS FLOAT) AS y, CAST(hour(ts) AS FLOAT) AS z, "
    "CAST(event_id % 256 AS INTEGER) AS r, CAST(user_id % 256 AS INTEGER) AS g, CAST((event_id * 7) % 256 AS INTEGER) AS b FROM events",
}
