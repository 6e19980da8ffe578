"""Record types. A cloud is the rows of one ``cloud_id``; ``idx`` is a record's place in it, as DataFrames have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = [T.StructField("cloud_id", T.StringType()), T.StructField("idx", T.LongType())]


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


#: Colour channels are 0..255 in SMALLINT: Spark has no unsigned byte.
POINT = T.StructType([*_KEY, *_fields("x y z", T.FloatType()), *_fields("r g b", T.ShortType())])
POINT_ALPHA = T.StructType([*POINT.fields, *_fields("a", T.ShortType())])
SPLAT = T.StructType([*POINT_ALPHA.fields, *_fields("scale_x scale_y scale_z rot_w rot_x rot_y rot_z", T.FloatType())])
PAYLOAD = T.StructType(
    [T.StructField("cloud_id", T.StringType()), T.StructField("codec_chain", T.ArrayType(T.StringType())), T.StructField("payload", T.BinaryType()), *_fields("n_points bytes", T.LongType())]
)
SCHEMAS = {"points": POINT, "points_rgba": POINT_ALPHA, "splats": SPLAT}


def kind_of(df: DataFrame) -> str:
    """points, points_rgba or splats, by column names."""
    names = set(df.columns)
    if not {"cloud_id", "idx", "x", "y", "z"} <= names:
        raise ValueError(f"not a cloud: {df.columns}")
    return "splats" if set(SPLAT.names) <= names else "points_rgba" if {"r", "g", "b", "a"} <= names else "points"


def double_positions(df: DataFrame) -> bool:
    return isinstance(df.schema["x"].dataType, T.DoubleType)


def u8(c: Column) -> Column:
    """A colour value, checked."""
    return F.when(c.between(0, 255), c.cast("short")).otherwise(F.raise_error(F.concat(F.lit("not in 0..255: "), c.cast("string"))).cast("short"))
