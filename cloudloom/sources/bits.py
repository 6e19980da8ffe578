"""Little-endian bit streams of fields with fixed widths, by numpy bit matrices."""

from __future__ import annotations

import numpy as np

from ..errors import FormatError

#: Records that are unfolded into bits at once.
STEP = 1 << 16


def pack(fields: list[np.ndarray], widths: list[int]) -> bytes:
    """Records of unsigned fields, lowest bit first; the last byte is filled with zeros."""
    n, total = len(fields[0]) if fields else 0, sum(widths)
    if not n or not total:
        return b""
    out, rest = [], np.zeros(0, np.uint8)
    for i in range(0, n, STEP):
        rows = [f[i : i + STEP].astype(np.uint64) for f in fields]
        bits = np.empty((len(rows[0]), total), np.uint8)
        at = 0
        for value, width in zip(rows, widths, strict=True):
            bits[:, at : at + width] = value[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
            at += width
        flat = np.concatenate([rest, bits.ravel()])
        whole = len(flat) if i + STEP >= n else len(flat) // 8 * 8
        out.append(np.packbits(flat[:whole], bitorder="little").tobytes())
        rest = flat[whole:]
    return b"".join(out)


def unpack(data: memoryview | bytes, n: int, widths: list[int]) -> list[np.ndarray]:
    total = sum(widths)
    if len(data) * 8 < n * total:
        raise FormatError(f"{n} records of {total} bits don't fit into {len(data)} bytes")
    out = [np.zeros(n, np.uint64) for _ in widths]
    raw = np.frombuffer(data, np.uint8)
    for i in range(0, n, STEP):
        m = min(STEP, n - i)  # STEP records are a whole number of bytes
        part = raw[i * total // 8 : -(-(i + m) * total // 8)]
        bits = np.unpackbits(part, bitorder="little")[: m * total].reshape(m, total)
        at = 0
        for value, width in zip(out, widths, strict=True):
            value[i : i + m] = (bits[:, at : at + width].astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            at += width
    return out
