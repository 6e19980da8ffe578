"""The lossless layout (magic BC1): a small header, then one array after the other.

The header has a layout number of its own, so that these bytes aren't taken for another library's body under the same magic.
"""

from __future__ import annotations

import struct

import numpy as np

from ..errors import CodecError, FormatError
from .cloud import Cloud
from .reading import Cursor

MAGIC = b"BC1"
LAYOUT = 0xC1
KINDS = ["points", "points_rgba", "splats"]
MOST_HEADER, MOST_BODY = 1024, 1_500_000_000


def encode(cloud: Cloud, _: object = None) -> bytes:
    wide = cloud.xyz.dtype == np.float64
    if wide and cloud.scale is not None:
        raise CodecError("splats have 32-bit positions")
    parts = [cloud.xyz.astype("<f8" if wide else "<f4").tobytes(), cloud.rgb.tobytes()]
    if cloud.alpha is not None:
        parts.append(cloud.alpha.tobytes())
    if cloud.scale is not None:
        parts += [cloud.scale.astype("<f4").tobytes(), cloud.rotation.astype("<f4").tobytes()]
    head = struct.pack("<BBBBQ", LAYOUT, KINDS.index(cloud.kind), int(wide), 0, len(cloud))
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def decode(data: bytes) -> Cloud:
    c = Cursor(data)
    c.magic(MAGIC)
    (size,) = c.unpack("I")
    if not 1 <= size <= MOST_HEADER or len(data) > MOST_BODY:
        raise FormatError("header or body out of bounds")
    head = Cursor(bytes(c.take(size)))
    layout, kind, wide, _, n = head.unpack("BBBBQ")
    if layout != LAYOUT or kind >= len(KINDS):
        raise FormatError("another body layout")
    read = lambda form, k: np.frombuffer(c.take(np.dtype(form).itemsize * n * k), form).reshape(n, k)
    out = Cloud(read("<f8" if wide else "<f4", 3), read("u1", 3))
    if KINDS[kind] != "points":
        out.alpha = read("u1", 1)[:, 0]
    if KINDS[kind] == "splats":
        out.scale, out.rotation = read("<f4", 3), read("<f4", 4)
    if c.at != len(data):
        raise FormatError("bytes after the body")
    return out
