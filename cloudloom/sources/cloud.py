"""One cloud as numpy arrays: what the byte layouts work on, between Arrow tables and payloads."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

SCALES = ("scale_x", "scale_y", "scale_z")
ROTATIONS = ("rot_w", "rot_x", "rot_y", "rot_z")


@dataclass
class Cloud:
    """Positions (n, 3) in 32 or 64 bits, colours (n, 3) and alphas (n,) in bytes, scales (n, 3) and rotations w, x, y, z (n, 4)."""

    xyz: np.ndarray
    rgb: np.ndarray
    alpha: np.ndarray | None = None
    scale: np.ndarray | None = None
    rotation: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.xyz)

    @property
    def kind(self) -> str:
        return "splats" if self.scale is not None else "points" if self.alpha is None else "points_rgba"

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Cloud:
        """From the rows of one cloud, put in the order of idx."""
        names = table.schema.names
        order = np.argsort(column(table, "idx"), kind="stable")
        stack = lambda cols, kind=None: np.stack([column(table, c)[order] for c in cols], axis=1).astype(kind) if kind else np.stack([column(table, c)[order] for c in cols], axis=1)
        xyz = stack("xyz")
        rgb = stack("rgb", np.uint8) if "r" in names else np.zeros((len(order), 3), np.uint8)
        alpha = column(table, "a")[order].astype(np.uint8) if "a" in names else None
        splat = "scale_x" in names
        return cls(xyz, rgb, alpha, stack(SCALES, np.float32) if splat else None, stack(ROTATIONS, np.float32) if splat else None)

    def as_kind(self, kind: str) -> Cloud:
        """The same records as another kind: missing alphas are opaque, missing splat fields the unit ones, others are dropped."""
        n = len(self)
        if kind == "points":
            return Cloud(self.xyz, self.rgb)
        alpha = self.alpha if self.alpha is not None else np.full(n, 255, np.uint8)
        if kind == "points_rgba":
            return Cloud(self.xyz, self.rgb, alpha)
        scale = self.scale if self.scale is not None else np.ones((n, 3), np.float32)
        rotation = self.rotation if self.rotation is not None else np.tile(np.array([1, 0, 0, 0], np.float32), (n, 1))
        return replace(self, alpha=alpha, scale=scale, rotation=rotation)

    def columns(self) -> dict[str, np.ndarray]:
        out = {c: np.ascontiguousarray(self.xyz[:, i]) for i, c in enumerate("xyz")}
        out |= {c: self.rgb[:, i].astype(np.int16) for i, c in enumerate("rgb")}
        if self.alpha is not None:
            out["a"] = self.alpha.astype(np.int16)
        if self.scale is not None:
            out |= {c: np.ascontiguousarray(self.scale[:, i]) for i, c in enumerate(SCALES)}
            out |= {c: np.ascontiguousarray(self.rotation[:, i]) for i, c in enumerate(ROTATIONS)}
        return out


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    c = table.column(table.schema.names.index(name))
    return c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)
