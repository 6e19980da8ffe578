"""Z-order codes as bit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread(v: Column) -> Column:
    """The low 21 bits with two zero bits after each."""
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def code(x: Column, y: Column, z: Column) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))
