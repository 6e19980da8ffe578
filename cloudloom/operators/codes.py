"""Quantised codes of clouds, and back: the relational part of the codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morton, quant
from .bounds import with_bounds


def in_order():
    return Window.partitionBy("cloud_id").orderBy("idx")


def quantise_positions(points: DataFrame, bits: int) -> DataFrame:
    """Adds qx, qy, qz; keeps the bounds, which the way back needs."""
    return with_bounds(points).withColumns({f"q{c}": quant.quantise(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}"), bits) for c in "xyz"})


def dequantise_positions(codes: DataFrame, bits: int) -> DataFrame:
    return codes.withColumns({f"d{c}": quant.dequantise(F.col(f"q{c}"), F.col(f"min_{c}"), F.col(f"max_{c}"), bits) for c in "xyz"})


def quantise_colours(points: DataFrame, bits: int) -> DataFrame:
    out = with_bounds(points, colours=True)
    return out.withColumns({f"q{c}": quant.quantise_colour(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}"), bits) for c in "rgb"})


def dequantise_colours(codes: DataFrame, bits: int) -> DataFrame:
    return codes.withColumns({f"d{c}": quant.dequantise_colour(F.col(f"q{c}"), F.col(f"min_{c}"), F.col(f"max_{c}"), bits) for c in "rgb"})


def round_trip(points: DataFrame, position_bits: int, colour_bits: int) -> DataFrame:
    """What a quantised payload gives back, as points."""
    codes = quantise_colours(points, colour_bits)
    codes = codes.withColumns({f"q{c}": quant.quantise(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}"), position_bits) for c in "xyz"})
    codes = dequantise_colours(dequantise_positions(codes, position_bits), colour_bits)
    return codes.select("cloud_id", "idx", *(F.col(f"d{c}").alias(c) for c in "xyzrgb"))


def delta_encode(codes: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Adds delta_<column>: the difference to the previous record, modulo 2^bits."""
    return codes.withColumns({f"delta_{c}": quant.delta(F.col(c), F.lag(c, 1, 0).over(in_order()), bits) for c in columns})


def delta_decode(deltas: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Adds sum_<column>: the running sum of delta_<column>, modulo 2^bits."""
    running = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumns({f"sum_{c}": F.sum(f"delta_{c}").over(running).bitwiseAND(F.lit(quant.top(bits))) for c in columns})


def morton_order(points: DataFrame, bits: int = 16) -> DataFrame:
    """Adds the Z-order code and the place in Z-order; ties by idx."""
    codes = quantise_positions(points, bits).withColumn("morton", morton.code(F.col("qx"), F.col("qy"), F.col("qz")))
    return codes.withColumn("rank", F.row_number().over(Window.partitionBy("cloud_id").orderBy("morton", "idx")) - 1)


def planes(points: DataFrame, bits: int) -> DataFrame:
    """Low and high bytes of the codes."""
    codes = quantise_positions(points, bits)
    low = {f"lo_{c}": F.col(f"q{c}").bitwiseAND(F.lit(255)) for c in "xyz"}
    high = {f"hi_{c}": F.shiftright(f"q{c}", 8) for c in "xyz"}
    return codes.withColumns(low | high)
