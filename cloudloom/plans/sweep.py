"""Codec sweeps: each configuration codes every cloud, and what comes back is measured."""

from __future__ import annotations

import json
import time
import tomllib
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators import quality, sampling
from ..sources import registry
from ..sources.cloud import Cloud


@dataclass(frozen=True)
class Metrics:
    symmetric: bool = True
    k_normals: int = 16
    outlier_threshold: dict[str, Any] = field(default_factory=lambda: {"kind": "mad3"})
    normal_angle: bool = True
    d2: bool = True
    color_psnr: bool = True


@dataclass(frozen=True)
class Config:
    roots: list[str]
    sweeps: list[tuple[str, Any]]
    metrics: Metrics
    resample: dict[str, Any] | None


def read_config(text: str) -> Config:
    """A benchmark description in TOML. Unknown keys raise; a sweep whose codec isn't available is kept, and gives an error row."""
    tree = tomllib.loads(text)
    if extra := set(tree) - {"datasets", "sweeps", "metrics"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    known = {f for f in Metrics.__dataclass_fields__}
    given = tree.get("metrics", {})
    if extra := set(given) - known:
        raise ValueError(f"unknown metrics: {sorted(extra)}")
    sweeps = [(s.get("name") or P.label(P.parse(s["params"])), s["params"]) for s in tree["sweeps"]]
    return Config(tree["datasets"]["roots"], sweeps, Metrics(**given), tree["datasets"].get("resample"))


def resample(points: DataFrame, spec: dict[str, Any] | None, seed: int = 0) -> DataFrame:
    """One of the strategies rate, count, biased and partition."""
    if spec is None:
        return points
    kind = spec["strategy"]
    if kind == "rate":
        return sampling.by_rate(points, spec["rate"], seed)
    if kind == "count":
        return sampling.by_count(points, spec["count"], seed)
    if kind == "biased":
        centres = [tuple(c) if isinstance(c, list) else (c["x"], c["y"], c["z"]) for c in spec["roi_centers"]]
        return sampling.by_interest(points, spec["count"], centres, spec["radius"], spec["roi_weight"], seed)
    if kind == "partition":
        return sampling.partition(points, spec["percentages"], spec["pick"], seed)
    raise ValueError(f"unknown strategy {kind}")


def code(points: DataFrame, params: P.Params, warm_up: bool = True) -> DataFrame:
    """Every cloud coded and decoded in one task: its points as they come back, and bytes and times on the row of idx 0."""
    P.validate(params, "points")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cloud = Cloud.of(table)
        if warm_up:
            registry.decode(registry.encode(cloud, params))
        t0 = time.perf_counter_ns()
        payload = registry.encode(cloud, params)
        t1 = time.perf_counter_ns()
        back = registry.decode(payload).as_kind("points")
        t2 = time.perf_counter_ns()
        n = len(back)
        columns = back.columns()
        rows = {"cloud_id": pa.array([key[0].as_py()] * n, pa.string()), "idx": pa.array(range(n), pa.int64())}
        rows |= {c: pa.array(columns[c].astype("float32")) for c in "xyz"} | {c: pa.array(columns[c]) for c in "rgb"}
        for name, value in (("bytes", len(payload)), ("encode_ns", t1 - t0), ("decode_ns", t2 - t1)):
            rows[name] = pa.array([value] + [None] * (n - 1) if n else [], pa.int64())
        return pa.table(rows)

    out = "cloud_id string, idx long, x float, y float, z float, r smallint, g smallint, b smallint, bytes long, encode_ns long, decode_ns long"
    return points.select("cloud_id", "idx", "x", "y", "z", "r", "g", "b").groupBy("cloud_id").applyInArrow(run, out)


def bits_per_point(size, n):
    return F.lit(8.0) * size / F.greatest(n, F.lit(1))


def measure(back: DataFrame, ref: DataFrame, metrics: Metrics) -> DataFrame:
    """One row per cloud: all metrics that are switched on, null where off. Angles between normals aren't measured and are null."""
    pairs = quality.matches(back, ref).persist()
    distances = (quality.positional_symmetric(back, ref, pairs) if metrics.symmetric else pairs.select("cloud_id", "idx", "dist")).persist()
    out = quality.distance_metrics(distances)
    limit = metrics.outlier_threshold
    beyond = quality.outliers_beyond(distances, limit["distance"]) if limit["kind"] == "abs" else quality.outliers_mad3(distances)
    out = out.join(beyond, "cloud_id")
    none = F.lit(None).cast("double")
    if metrics.d2:
        planes = quality.point_to_plane(back, ref, quality.pca_normals(ref, metrics.k_normals), pairs)
        out = out.join(quality.distance_metrics(planes, "d2"), "cloud_id")
    else:
        out = out.withColumns({f"d2_{n}": none for n in ("rmse", "median", "p95")})
    if metrics.color_psnr:
        out = out.join(quality.colour_metrics(back, ref, pairs).select("cloud_id", "y_psnr", "cb_psnr", "cr_psnr"), "cloud_id")
    else:
        out = out.withColumns({f"{n}_psnr": none for n in ("y", "cb", "cr")})
    return out.withColumns({"n_ang_mean_deg": none, "n_ang_p95_deg": none})


def run(points: DataFrame, config: Config) -> DataFrame:
    """Outcomes of all sweeps over all clouds, in the fixed columns; what fails has null figures and an ``error``."""
    ref = resample(points, config.resample).persist()
    counts = ref.groupBy("cloud_id").agg(F.count("*").alias("num_points_ref"))
    parts = []
    for name, tree in config.sweeps:
        try:
            params = P.parse(tree)
            shown = json.dumps({P.name_of(params): asdict(params)}, default=str)
            registry.encode(_PROBE, params)  # a codec that is not available shows here
            coded = code(ref, params).persist()
            sizes = coded.groupBy("cloud_id").agg(F.count("*").alias("num_points_dec"), *(F.max(c).alias(c) for c in ("bytes", "encode_ns", "decode_ns")))
            out = counts.join(sizes, "cloud_id").join(measure(coded, ref, config.metrics), "cloud_id")
            out = out.withColumn("bpp", bits_per_point(F.col("bytes"), F.col("num_points_ref")))
            out = out.withColumns({"encode_ms": F.col("encode_ns") / F.lit(1e6), "decode_ms": F.col("decode_ns") / F.lit(1e6), "error": F.lit(None).cast("string")})
        except (ValueError, KeyError) as e:
            shown, out = json.dumps(tree, default=str), counts.withColumn("error", F.lit(f"{type(e).__name__}: {e}"))
        parts.append(out.withColumnRenamed("cloud_id", "dataset_id").withColumns({"sweep_name": F.lit(name), "params_json": F.lit(shown), "dataset_path": F.col("dataset_id")}))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


_PROBE = Cloud(np.array([[0, 0, 0], [1, 2, 3]], np.float32), np.array([[0, 0, 0], [1, 2, 3]], np.uint8))


def summary(outcomes: DataFrame, group: str = "sweep_name", columns: tuple[str, ...] = ("bpp", "d1_rmse", "y_psnr")) -> DataFrame:
    """Per sweep, upper medians: the element at n div 2 of the sorted values; nulls are left out."""
    middle = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))
    return outcomes.groupBy(group).agg(F.count("*").alias("n"), *(middle(c).alias(f"{c}_median") for c in columns)).orderBy(group)
