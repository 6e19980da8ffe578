"""Quantisation as column expressions. Divisions are cast back to FLOAT, so that results are those of 32-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges up to the machine epsilon count as zero.
EPS_FLOAT, EPS_DOUBLE = 1.1920928955078125e-07, 2.220446049250313e-16


def clamp_bits(bits: int) -> int:
    return min(max(bits, 1), 32)


def top(bits: int) -> int:
    return (1 << clamp_bits(bits)) - 1


def scale(lo: Column, hi: Column, bits: int) -> Column:
    """Codes per unit in FLOAT; 0 where there is no range."""
    span = (hi - lo).cast("float")
    return F.when(span > F.lit(EPS_FLOAT).cast("float"), (F.lit(float(top(bits))).cast("float") / span).cast("float")).otherwise(F.lit(0.0).cast("float"))


def quantise(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """floor((v - lo) * scale + 1/2), held in 0..2^bits - 1."""
    s = scale(lo, hi, bits)
    code = F.floor((((v - lo).cast("float") * s).cast("float") + F.lit(0.5).cast("float")).cast("float")).cast("long")
    return F.when(s == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.lit(top(bits)), code)))


def dequantise(code: Column, lo: Column, hi: Column, bits: int) -> Column:
    """lo + code * (range / top), as one rounding to FLOAT."""
    span = (hi - lo).cast("float")
    step = (span / F.lit(float(top(bits))).cast("float")).cast("float")
    return F.when(span <= 0, lo).otherwise((code.cast("double") * step.cast("double") + lo.cast("double")).cast("float"))


def quantise_colour(c: Column, lo: Column, hi: Column, bits: int) -> Column:
    """The same on colour channels; 8 bits over the full range are the channel itself."""
    code = quantise(c.cast("float"), lo.cast("float"), hi.cast("float"), bits)
    return F.when((lo == 0) & (hi == 255) & F.lit(bits == 8), c.cast("long")).otherwise(code)


def dequantise_colour(code: Column, lo: Column, hi: Column, bits: int) -> Column:
    span = (hi - lo).cast("float")
    step = (span / F.lit(float(top(bits))).cast("float")).cast("float")
    value = F.round(code.cast("double") * step.cast("double") + lo.cast("double"))
    return F.greatest(F.lit(0), F.least(F.lit(255), value.cast("int")))


def storage_bits(bits: Column | int, packed: bool) -> Column:
    """Bits that a code takes: its own when packed, else the next of 0, 8, 16 and 32."""
    b = F.lit(bits) if isinstance(bits, int) else bits
    return b if packed else F.when(b == 0, 0).when(b <= 8, 8).when(b <= 16, 16).otherwise(32)


def index_bits(n: Column) -> Column:
    """Bits that number n palette entries: ceil(log2 n), 0 for one or none."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))


def delta(code: Column, previous: Column, bits: int) -> Column:
    return (code - previous).bitwiseAND(F.lit(top(bits)))
