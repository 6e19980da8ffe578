"""Gaussian splat attributes: the PLY convention and the byte codes of fixed-width records."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1 / (2 sqrt(pi)), and the code ranges of the fixed-width record.
SH_C0 = 0.28209479177387814
SCALE_LO, SCALE_SPAN, SCALE_STEPS, SCALE_LEAST = -12.0, 21.0, 254.0, -30.0


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def to_dc(c: Column) -> Column:
    return (c.cast("double") / F.lit(255.0) - F.lit(0.5)) / F.lit(SH_C0)


def to_logit(a: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), a.cast("double") / F.lit(255.0)))
    return F.ln(p / (F.lit(1.0) - p))


def log_scale(s: Column) -> Column:
    s = s.cast("double")
    return F.when(finite(s) & (s > 0), F.ln(s)).otherwise(F.lit(0.0))


def finite_or(v: Column, other: float) -> Column:
    return F.when(finite(v), v.cast("double")).otherwise(F.lit(other))


def unit_to_u8(v: Column, compat: bool = False) -> Column:
    """0..1 to 0..255. Values outside are clamped; compat takes those above 1 as bytes already."""
    inside = F.floor(v * F.lit(255.0) + F.lit(0.5))
    if compat:
        inside = F.when((v >= 0) & (v <= 1), inside).otherwise(F.floor(v + F.lit(0.5)))
    held = F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(inside, F.lit(0)).cast("int")))
    return F.when(F.isnan(v), F.lit(0)).otherwise(held)


def from_dc(f: Column, compat: bool = False) -> Column:
    return unit_to_u8(F.lit(SH_C0) * f.cast("double") + F.lit(0.5), compat)


def sigmoid(v: Column) -> Column:
    """In the form that doesn't overflow."""
    v = v.cast("double")
    e = F.exp(-F.abs(v))
    return F.when(v >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def from_logit(o: Column) -> Column:
    return unit_to_u8(sigmoid(o))


def scalar_to_u8(v: Column, compat: bool = False) -> Column:
    """A float channel: 0..1 counts as a share, anything else as a byte."""
    return unit_to_u8(v.cast("double"), True)


def scale_code(s: Column) -> Column:
    s = s.cast("double")
    code = F.round((F.ln(s) - F.lit(SCALE_LO)) * F.lit(SCALE_STEPS / SCALE_SPAN) + F.lit(1.0))
    usable = finite(s) & (s > 0) & (s >= F.lit(math.exp(SCALE_LEAST)))
    return F.when(usable, F.greatest(F.lit(1), F.least(F.lit(255), code.cast("int")))).otherwise(F.lit(0))


def scale_value(code: Column) -> Column:
    return F.when(code == 0, F.lit(0.0)).otherwise(F.exp(F.lit(SCALE_LO) + (code.cast("double") - F.lit(1.0)) * F.lit(SCALE_SPAN / SCALE_STEPS)))


def _byte(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * F.lit(255.0) + F.lit(0.5)).cast("int")


def rotation_codes(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Octahedral axis (u, v) and angle of a quaternion, a byte each."""
    w, x, y, z = (c.cast("double") for c in (w, x, y, z))
    length = F.sqrt(w * w + x * x + y * y + z * z)
    sign = F.when(w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    unit = lambda c, other: F.when(length > 0, sign * c / length).otherwise(F.lit(other))
    w, x, y, z = unit(w, 1.0), unit(x, 0.0), unit(y, 0.0), unit(z, 0.0)
    w = F.least(F.lit(1.0), w)
    theta = F.lit(2.0) * F.acos(w)
    s = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - w * w))
    along = lambda c, other: F.when(s > 1e-8, c / s).otherwise(F.lit(other))
    x, y, z = along(x, 1.0), along(y, 0.0), along(z, 0.0)
    total = F.abs(x) + F.abs(y) + F.abs(z)
    u, v = x / total, y / total
    side = lambda c: F.when(c < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    fu, fv = (F.lit(1.0) - F.abs(v)) * side(u), (F.lit(1.0) - F.abs(u)) * side(v)
    u, v = F.when(z < 0, fu).otherwise(u), F.when(z < 0, fv).otherwise(v)
    half = lambda c: _byte(c * F.lit(0.5) + F.lit(0.5))
    return half(u), half(v), _byte(theta / F.lit(math.pi))


def rotation_values(u: Column, v: Column, angle: Column) -> list[Column]:
    """The quaternion (w, x, y, z) of the codes."""
    a, b = (c.cast("double") / F.lit(255.0) * F.lit(2.0) - F.lit(1.0) for c in (u, v))
    z = F.lit(1.0) - F.abs(a) - F.abs(b)
    side = lambda c: F.when(c < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    x = F.when(z < 0, (F.lit(1.0) - F.abs(b)) * side(a)).otherwise(a)
    y = F.when(z < 0, (F.lit(1.0) - F.abs(a)) * side(b)).otherwise(b)
    length = F.sqrt(x * x + y * y + z * z)
    half = angle.cast("double") / F.lit(255.0) * F.lit(math.pi) * F.lit(0.5)
    return [F.cos(half), *(F.sin(half) * c / length for c in (x, y, z))]


def normalised(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A unit quaternion; of length zero or not finite, the identity."""
    parts = [c.cast("double") for c in (w, x, y, z)]
    length = F.sqrt(sum((c * c for c in parts), F.lit(0.0)))
    fine = finite(length) & (length > 0)
    return [F.when(fine, c / length).otherwise(F.lit(other)) for c, other in zip(parts, (1.0, 0.0, 0.0, 0.0), strict=True)]


def half_bits(v: Column) -> Column:
    """The bits of the nearest 16-bit float (ties to even) of a finite number below 65520."""
    a = F.abs(v.cast("double"))
    exponent = F.greatest(F.lit(-14.0), F.floor(F.log2(a)).cast("double"))
    bits = ((exponent + 14) * 1024 + F.rint(a / F.pow(F.lit(2.0), exponent - 10))).cast("int")
    return F.when(v == 0, 0).otherwise(bits) + F.when(v < 0, 1 << 15).otherwise(0)


def words(r: Column, g: Column, b: Column, a: Column, half_x: Column, half_y: Column, half_z: Column, u: Column, v: Column, angle: Column, sx: Column, sy: Column, sz: Column) -> list[Column]:
    """The four 32-bit words of a record, as BIGINT; half_*: the bits of 16-bit floats."""
    join = lambda *parts: sum((F.shiftleft(c.cast("long"), s) for c, s in parts), F.lit(0).cast("long"))
    return [
        join((r, 0), (g, 8), (b, 16), (a, 24)),
        join((half_x, 0), (half_y, 16)),
        join((half_z, 0), (u, 16), (v, 24)),
        join((sx, 0), (sy, 8), (sz, 16), (angle, 24)),
    ]
