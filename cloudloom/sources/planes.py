"""The byte-plane layout (magic SGP): low bytes, high bytes and colours, each a plane, in Z-order."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import CodecError, FeatureDisabled, FormatError
from ..params import Sogp
from . import wrap
from .cloud import Cloud
from .quantised import EPS, F32, bounds, dequantise
from .reading import Cursor

MAGIC = b"SGP"
COLOUR, HIGH, MORTON, PACKED = 1, 2, 4, 8
LOW_PLANE, HIGH_PLANE, RGB_PLANE, ALL_PLANES = 0, 1, 2, 255
COMPRESSIONS = ["None", "Zstd", "Lz4", "Snappy", "OpenzlSerial"]
#: Guards against small payloads that claim to be large.
MOST_BYTES, MOST_EXPANSION = 2 << 30, 512


def compression_of(p: Sogp) -> tuple[int, int | None]:
    """Number and level of a compression given by name, or as a table with a kind."""
    kind, level = (p.compression.get("kind", "zstd"), p.compression.get("level")) if isinstance(p.compression, dict) else (p.compression, None)
    names = [c.lower() for c in COMPRESSIONS]
    plain = str(kind).lower().replace("-", "").replace("_", "")
    if plain not in names:
        raise CodecError(f"unknown compression {kind}")
    return names.index(plain), level


def spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64) & np.uint64(0x1FFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


def codes(xyz: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: int) -> np.ndarray:
    span = np.maximum(hi - lo, F32(0))
    inverse = np.where(span > EPS, F32(1) / np.where(span > EPS, span, F32(1)), F32(0)).astype(F32)
    top = F32((1 << b) - 1)
    return np.clip(np.floor((xyz.astype(F32) - lo) * inverse * top + F32(0.5)), 0, top).astype(np.int64)


def morton_order(xyz: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Z-order on 16 bits an axis; ties by place."""
    q = codes(xyz, lo, hi, 16)
    return np.argsort(spread(q[:, 0]) | spread(q[:, 1]) << np.uint64(1) | spread(q[:, 2]) << np.uint64(2), kind="stable")


def _squeeze(number: int, level: int | None, data: bytes) -> bytes:
    if number == 0:
        return data
    if number == 4:
        raise FeatureDisabled("OpenZL isn't available")
    return wrap.pack(COMPRESSIONS[number], data, level)


def encode(cloud: Cloud, p: Sogp) -> bytes:
    n = len(cloud)
    if not n or not np.isfinite(cloud.xyz).all():
        raise CodecError("byte planes need finite positions, and at least one")
    number, level = compression_of(p)
    lo, hi = bounds(cloud.xyz)
    order = morton_order(cloud.xyz, lo, hi) if p.morton_order and n > 1 else np.arange(n)
    q = codes(cloud.xyz[order], lo, hi, p.pos_bits)
    planes = [(LOW_PLANE, (q & 0xFF).astype(np.uint8).tobytes())]
    if p.pos_bits > 8:
        planes.append((HIGH_PLANE, (q >> 8).astype(np.uint8).tobytes()))
    if p.include_color:
        planes.append((RGB_PLANE, cloud.rgb[order].tobytes()))
    flags = COLOUR * p.include_color | HIGH * (p.pos_bits > 8) | MORTON * p.morton_order | PACKED * p.packed_stream
    if p.packed_stream:
        planes = [(ALL_PLANES, b"".join(b for _, b in planes))]
    out = MAGIC + bytes([1, flags, p.pos_bits, number, 0]) + struct.pack("<I6fB", n, *lo, *hi, len(planes))
    for name, plain in planes:
        packed = _squeeze(number, level, plain)
        out += struct.pack("<BII", name, len(plain), len(packed)) + packed
    return out


def decode(data: bytes) -> Cloud:
    c = Cursor(data)
    c.magic(MAGIC)
    version, flags, b, number, _ = c.unpack("5B")
    if version != 1 or not 1 <= b <= 16 or number >= len(COMPRESSIONS):
        raise FormatError("unknown version, bits or compression")
    n, *box = c.unpack("I6f")
    lo, hi = np.array(box[:3], F32), np.array(box[3:], F32)
    (count,) = c.unpack("B")
    streams: dict[int, bytes] = {}
    for _ in range(count):
        name, plain, packed = c.unpack("BII")
        if name in streams or plain > MOST_BYTES or plain > MOST_EXPANSION * max(len(data), 1):
            raise FormatError("a stream twice, or one that is too large")
        body = bytes(c.take(packed))
        if number == 4:
            raise FeatureDisabled("OpenZL isn't available")
        streams[name] = body if number == 0 else wrap.unpack(COMPRESSIONS[number], body, plain + 1)
        if len(streams[name]) != plain:
            raise FormatError("a stream of another length than it says")
    if not n:
        return Cloud(np.zeros((0, 3), F32), np.zeros((0, 3), np.uint8))
    wanted = [LOW_PLANE] + [HIGH_PLANE] * bool(flags & HIGH) + [RGB_PLANE] * bool(flags & COLOUR)
    whole = streams.get(ALL_PLANES, b"")
    planes = {name: whole[3 * n * i : 3 * n * (i + 1)] if flags & PACKED else streams.get(name, b"") for i, name in enumerate(wanted)}
    if any(len(plane) != 3 * n for plane in planes.values()):
        raise FormatError("a plane is missing or of the wrong length")
    read = lambda name: np.frombuffer(planes[name], np.uint8).reshape(n, 3) if name in planes else np.zeros((n, 3), np.uint8)
    q = read(LOW_PLANE).astype(np.float64) + 256.0 * read(HIGH_PLANE)
    return Cloud(dequantise(q, lo, hi, b).astype(F32), read(RGB_PLANE).copy())
