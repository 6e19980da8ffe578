"""Colour arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BT.709, full range, rows Y, Cb and Cr; the last two are raised by 128.
MATRIX = ((0.2126, 0.7152, 0.0722), (-0.1146, -0.3854, 0.5), (0.5, -0.4542, -0.0458))


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    channels = [c.cast("double") for c in (r, g, b)]
    out = [sum((F.lit(k) * c for k, c in zip(row[1:], channels[1:], strict=True)), F.lit(row[0]) * channels[0]) for row in MATRIX]
    return [out[0], out[1] + F.lit(128.0), out[2] + F.lit(128.0)]


def psnr(mse: Column) -> Column:
    """20 log10(255 / sqrt(mse)); infinite without an error."""
    return F.when(mse <= 0, F.lit(float("inf"))).otherwise(F.lit(20.0) * F.log10(F.lit(255.0) / F.sqrt(mse)))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    r, g, b = (c.cast("long") for c in (r, g, b))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack_rgb(v: Column) -> list[Column]:
    return [F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("int") for s in (16, 8, 0)]
