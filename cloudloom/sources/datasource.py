"""``spark.read.format("pointcloud")``: files of any known payload as rows of points or splats."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import schema
from . import registry
from .files import EXTENSIONS


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PointCloudReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.target = options["path"], options.get("target", "points")
        self.recursive = options.get("recursive", "false") == "true"

    def partitions(self) -> list[File]:
        if os.path.isfile(self.path):
            return [File(self.path)]
        found = glob.glob(f"{self.path}/{'**/' if self.recursive else ''}*", recursive=self.recursive)
        files = sorted(f for f in found if f.rsplit(".", 1)[-1].lower() in EXTENSIONS and os.path.isfile(f))
        if not files:
            raise FileNotFoundError(f"no clouds in {self.path}")
        return [File(f) for f in files]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            cloud = registry.decode(f.read()).as_kind(self.target)
        name = os.path.splitext(os.path.basename(partition.path))[0]
        columns = cloud.columns()
        for i in range(0, len(cloud), 1 << 16):
            n = min(1 << 16, len(cloud) - i)
            rows = {"cloud_id": pa.array([name] * n, pa.string()), "idx": pa.array(np.arange(i, i + n), pa.int64())}
            for f in schema.SCHEMAS[self.target].fields[2:]:
                values = columns[f.name][i : i + n]
                rows[f.name] = pa.array(values.astype(np.float32) if values.dtype.kind == "f" else values)
            yield pa.RecordBatch.from_pydict(rows)


class PointCloudSource(DataSource):
    """Options: path, target (points, points_rgba, splats), recursive. For paths that only Spark reads, use files.read_payloads and payloads.decode."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> StructType:
        return schema.SCHEMAS[self.options.get("target", "points")]

    def reader(self, schema: StructType) -> PointCloudReader:
        return PointCloudReader(dict(self.options))
