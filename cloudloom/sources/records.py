"""Fixed-width records of 16 bytes (magic GSP): half-float positions, byte colours, scales and rotations.

Version 2 is for points with positions that no half float holds: the scale bytes, which say nothing about points, are the powers
of two by which x, y and z were divided. Readers of version 1 refuse it.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from ..errors import CodecError, FormatError
from ..functions.splat import SCALE_LEAST, SCALE_LO, SCALE_SPAN, SCALE_STEPS
from ..params import Gsplat16
from .cloud import Cloud
from .reading import Cursor

MAGIC = b"GSP"
SPLATS, ALPHA = 1, 2
WORDS = np.dtype([("colour", "u1", 4), ("half", "<f2", 3), ("axis", "u1", 2), ("scale", "u1", 3), ("angle", "u1")])
#: Positions from here on round to an infinite half float.
LARGEST = 65520.0
#: Positions from here on round to an infinite 32-bit float, with the eleven bits of a half float.
LARGEST_WIDE = 2.0**128 - 2.0**116
#: The axis code of no rotation.
IDENTITY = (255, 128)


def scale_codes(s: np.ndarray) -> np.ndarray:
    s = s.astype(np.float64)
    usable = np.isfinite(s) & (s >= math.exp(SCALE_LEAST))
    code = np.floor((np.log(np.where(usable, s, 1)) - SCALE_LO) * SCALE_STEPS / SCALE_SPAN + 1.5)
    return np.where(usable, np.clip(code, 1, 255), 0).astype(np.uint8)


def scale_values(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0, np.exp(SCALE_LO + (code.astype(np.float64) - 1) * SCALE_SPAN / SCALE_STEPS)).astype(np.float32)


def _byte(v: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)


def rotation_codes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axis (n, 2) and angle (n,) of quaternions w, x, y, z."""
    q = q.astype(np.float64)
    length = np.sqrt((q * q).sum(1))
    q = np.where((length > 0)[:, None], q / np.where(length > 0, length, 1)[:, None], [1, 0, 0, 0])
    q = q * np.where(q[:, :1] < 0, -1, 1)
    w = np.minimum(q[:, 0], 1)
    s = np.sqrt(np.maximum(1 - w * w, 0))
    axis = np.where((s > 1e-8)[:, None], q[:, 1:] / np.where(s > 1e-8, s, 1)[:, None], [1, 0, 0])
    axis = axis / np.abs(axis).sum(1, keepdims=True)
    uv = axis[:, :2]
    folded = (1 - np.abs(uv[:, ::-1])) * np.where(uv < 0, -1, 1)
    return _byte(np.where(axis[:, 2:] < 0, folded, uv) * 0.5 + 0.5), _byte(2 * np.arccos(w) / math.pi)


def rotation_values(axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    uv = axis / 255.0 * 2 - 1
    z = 1 - np.abs(uv).sum(1)
    unfolded = (1 - np.abs(uv[:, ::-1])) * np.where(uv < 0, -1, 1)
    v = np.concatenate([np.where(z[:, None] < 0, unfolded, uv), z[:, None]], axis=1)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    half = angle / 255.0 * math.pi / 2
    return np.concatenate([np.cos(half)[:, None], v * np.sin(half)[:, None]], axis=1).astype(np.float32)


def shifts(xyz: np.ndarray) -> np.ndarray:
    """Powers of two that bring positions into the range of half floats; 0 for those that are in it."""
    return np.where(np.abs(xyz) < LARGEST, 0, np.frexp(xyz)[1] - 15)


def encode(cloud: Cloud, p: Gsplat16) -> bytes:
    n = len(cloud)
    wide = p.wide_positions and cloud.scale is None
    bad = ~(np.isfinite(cloud.xyz) & (np.abs(cloud.xyz) < (LARGEST_WIDE if wide else LARGEST))).all(axis=1)
    if bad.any():
        raise CodecError(f"position {int(bad.argmax())} isn't finite as a half float")
    by = shifts(cloud.xyz)
    version = 2 if by.any() else 1
    out = np.zeros(n, WORDS)
    out["colour"][:, :3] = cloud.rgb
    out["colour"][:, 3] = 255 if cloud.alpha is None else cloud.alpha
    out["half"] = np.ldexp(cloud.xyz, -by)
    if cloud.scale is not None:
        if not (np.isfinite(cloud.scale).all() and np.isfinite(cloud.rotation).all()):
            raise CodecError("scales and rotations must be finite")
        out["scale"] = scale_codes(cloud.scale)
        out["axis"], out["angle"] = rotation_codes(cloud.rotation)
    else:
        out["scale"], out["axis"] = by if version == 2 else scale_codes(np.ones(1))[0], IDENTITY
    flags = SPLATS * (cloud.scale is not None) | ALPHA * (cloud.alpha is not None)
    return MAGIC + struct.pack("<BBBHII", version, flags, 0, 0, n, 0) + out.tobytes()


def decode(data: bytes) -> Cloud:
    c = Cursor(data)
    c.magic(MAGIC)
    version, flags, _, _, n, _ = c.unpack("BBBHII")
    if version not in (1, 2) or version == 2 and flags & SPLATS or len(data) != 16 + 16 * n:
        raise FormatError("unknown version, or not 16 bytes a record")
    rows = np.frombuffer(c.take(16 * n), WORDS)
    xyz = rows["half"].astype(np.float32)
    if version == 2:
        with np.errstate(over="ignore"):
            xyz = np.ldexp(xyz, rows["scale"].astype(np.int32))
    if not np.isfinite(xyz).all():
        raise FormatError("a position isn't finite")
    alpha = rows["colour"][:, 3].copy() if flags & (ALPHA | SPLATS) else None
    out = Cloud(xyz, rows["colour"][:, :3].copy(), alpha)
    if flags & SPLATS:
        out.scale, out.rotation = scale_values(rows["scale"]), rotation_values(rows["axis"], rows["angle"])
    return out
