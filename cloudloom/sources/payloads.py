"""Clouds to payloads and back, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from .. import schema
from . import ply, registry
from .cloud import Cloud

#: Records of one Arrow batch when a payload is decoded.
BATCH = 1 << 16


def encode(points: DataFrame, params: P.Params) -> DataFrame:
    """One payload row per cloud. The chain is checked before any plan is built.

    A cloud is one group and so bounded by an executor's memory; larger scenes are cut by the chunking operators first, whose chunk
    then is the cloud_id.
    """
    kind = schema.kind_of(points)
    P.validate(params, kind)
    names = P.chain(params)
    columns = [f.name for f in schema.SCHEMAS[kind].fields]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cloud = Cloud.of(table)
        payload = registry.encode(cloud, params)
        return pa.table({"cloud_id": pa.array([key[0].as_py()], pa.string()), "codec_chain": pa.array([names], pa.list_(pa.string())), "payload": pa.array([payload], pa.binary()), "n_points": pa.array([len(cloud)], pa.int64()), "bytes": pa.array([len(payload)], pa.int64())})

    return points.select(*(c for c in columns if c in points.columns)).groupBy("cloud_id").applyInArrow(run, schema.PAYLOAD)


def decode(payloads: DataFrame, target: str = "points") -> DataFrame:
    """The records of (cloud_id, payload) rows, in batches. target: points, points_rgba or splats."""
    out = schema.SCHEMAS[target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cloud = registry.decode(data.as_py()).as_kind(target)
                columns = cloud.columns()
                for i in range(0, max(len(cloud), 1), BATCH):
                    n = min(BATCH, len(cloud) - i)
                    rows = {"cloud_id": pa.array([name] * n, pa.string()), "idx": pa.array(np.arange(i, i + n), pa.int64())}
                    for f in out.fields[2:]:
                        values = columns[f.name][i : i + n]
                        rows[f.name] = pa.array(values.astype(np.float32) if values.dtype.kind == "f" else values)
                    yield pa.RecordBatch.from_pydict(rows)

    return payloads.select("cloud_id", "payload").mapInArrow(run, out)


def format_of(payload: Column) -> Column:
    """The format's name by its magic; unknown ones raise."""
    magic = F.substring(payload, 1, 3)
    out = F.when(F.length(payload) < 3, F.raise_error(F.lit("data too short")).cast("string"))
    for m, name in registry.MAGICS.items():
        out = out.when(magic == F.lit(m), name)
    return out.otherwise(F.raise_error(F.lit("unsupported data format")).cast("string"))


def flatten(points: DataFrame) -> DataFrame:
    """Per cloud, positions x, y, z, x, ... and colours r, g, b, r, ... in the order of idx."""
    rows = points.groupBy("cloud_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "z", "r", "g", "b"))).alias("rows"))
    part = lambda names: F.flatten(F.transform("rows", lambda p: F.array(*(p[n] for n in names))))
    return rows.select("cloud_id", part("xyz").alias("pos"), part("rgb").alias("color"))


def unflatten(arrays: DataFrame) -> DataFrame:
    """The points of flattened arrays; lengths must be equal and multiples of three."""
    ok = (F.size("pos") % 3 == 0) & (F.size("pos") == F.size("color"))
    checked = arrays.withColumn("pos", F.when(ok, F.col("pos")).otherwise(F.raise_error(F.lit("positions and colours must be triples of equal number")).cast(arrays.schema["pos"].dataType)))
    each = checked.select("cloud_id", "color", "pos", F.explode(F.expr("if(size(pos) > 0, sequence(0L, size(pos) div 3 - 1), array())")).alias("idx"))
    at = lambda c, k: F.get(c, (F.col("idx") * 3 + k).cast("int"))
    return each.select("cloud_id", "idx", *(at("pos", k).alias(n) for k, n in enumerate("xyz")), *(at("color", k).alias(n) for k, n in enumerate("rgb")))


def chunks(array: str | Column, n: int) -> Column:
    """A flat array as arrays of n; other lengths raise, n = 0 gives none."""
    a = F.col(array) if isinstance(array, str) else array
    if n == 0:
        return F.slice(F.array(a), 1, 0)
    parts = F.transform(F.sequence(F.lit(0), (F.size(a) / n).cast("int") - 1), lambda i: F.slice(a, i * n + 1, n))
    whole = F.when(F.size(a) == 0, F.slice(F.array(a), 1, 0)).otherwise(parts)
    return F.when(F.size(a) % n == 0, whole).otherwise(F.raise_error(F.lit(f"not a multiple of {n}")).cast("array<array<float>>"))


def ply_headers(payloads: DataFrame) -> DataFrame:
    """(cloud_id, element, size, ordinal, property, type, list_type) of PLY payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for e in ply.read_header(data.as_py()).elements:
                    rows += [(name, e.name, e.size, i, p.name, p.kind, p.count) for i, p in enumerate(e.properties)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_HEADER.replace(" long", "").replace(" int", "").replace(" string", "").split(", "))

    return payloads.select("cloud_id", "payload").mapInArrow(run, _HEADER)


_HEADER = "cloud_id string, element string, size long, ordinal int, property string, type string, list_type string"


class DecodePayload:
    """Table function: the records of one payload, for use in SQL with LATERAL."""

    def eval(self, payload: bytes):
        if payload is not None:
            cloud = registry.decode(bytes(payload)).as_kind("points")
            for i, (p, c) in enumerate(zip(cloud.xyz.tolist(), cloud.rgb.tolist(), strict=True)):
                yield (i, *map(float, p), *c)


def register(spark: SparkSession) -> None:
    """``SELECT * FROM payloads, LATERAL decode_payload(payload)``."""
    spark.udtf.register("decode_payload", F.udtf(DecodePayload, returnType="idx long, x float, y float, z float, r int, g int, b int", useArrow=True))
