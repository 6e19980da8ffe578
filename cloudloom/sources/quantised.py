"""The bit-packed quantised layout (magic QNT)."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import CodecError, FormatError
from ..params import Quantize
from . import bits
from .cloud import Cloud
from .reading import Cursor

MAGIC = b"QNT"
DELTA_POSITIONS, DELTA_COLOURS, WIDE_POSITIONS, WIDE_COLOURS = 1, 2, 4, 8
HAS_PALETTE, HAS_FLAGS, BITS_MASK = 0x80, 0x40, 0x3F
BASE = 40
#: Bytes by which a palette must win.
MARGIN = 256
EPS = np.float32(np.finfo(np.float32).eps)
F32 = np.float32


def width_of(b: int, packed: bool) -> int:
    return b if packed or b == 0 else 8 if b <= 8 else 16 if b <= 16 else 32


def index_width(n: int) -> int:
    return max(n - 1, 0).bit_length()


def palette_wins(n: int, position_bits: int, colour_bits: int, cap: int, packed: bool) -> bool:
    """Whether a palette of the configured cap is estimated to save bytes."""
    index = width_of(index_width(cap), packed)
    with_palette = -(-n * (position_bits + index) // 8) + 2 + 3 * cap
    return with_palette + MARGIN < -(-n * (position_bits + colour_bits) // 8)


def grid_bits(cap: int) -> int:
    return 5 if cap <= 4096 else 6


def bin_of(rgb: np.ndarray, g: int) -> np.ndarray:
    top = rgb.astype(np.int64) >> (8 - g)
    return top[:, 0] | top[:, 1] << g | top[:, 2] << 2 * g


def palette_of(rgb: np.ndarray, cap: int, compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (k, 3), their bins, and the entry of every record.

    The fullest bins make the palette (ties: smaller bin), each by its rounded mean colour. A record of another bin takes the entry
    that is nearest to the first colour of its bin within two bins around, the closest shell first; where there is none, the entry whose
    colour is nearest to the centre of the record's bin. compat: bins are decided in the order in which they are first met, and one that is decided counts as a bin of its entry
    for those after it.
    """
    g = grid_bits(cap)
    where = bin_of(rgb, g)
    bins, first, at, counts = np.unique(where, return_index=True, return_inverse=True, return_counts=True)
    sums = np.stack([np.bincount(at, rgb[:, c]) for c in range(3)], axis=1).astype(np.int64)
    order = np.lexsort((bins, -counts))[: min(max(cap, 1), len(bins))]
    entries = ((sums[order] + counts[order, None] // 2) // counts[order, None]).astype(np.uint8)
    slot = np.full(1 << 3 * g, -1)
    slot[bins[order]] = np.arange(len(order))
    chosen = slot[bins].copy()
    axes = lambda b: np.stack([b & (1 << g) - 1, b >> g & (1 << g) - 1, b >> 2 * g], axis=-1)
    centre = lambda b: (axes(b) << (8 - g)) + (1 << (7 - g))
    around = [(dr, dg, db) for dr in range(-2, 3) for dg in range(-2, 3) for db in range(-2, 3)]
    missed = np.flatnonzero(chosen < 0)
    for i in missed[np.argsort(first[missed])]:
        colour, own = rgb[first[i]].astype(np.int64), axes(bins[i])
        best = None
        for k, step in enumerate(around):
            near = own + step
            if (near < 0).any() or (near >= 1 << g).any():
                continue
            entry = slot[near[0] | near[1] << g | near[2] << 2 * g]
            if entry >= 0:
                far = int(((entries[entry].astype(np.int64) - colour) ** 2).sum())
                best = min(best or (9,), (max(map(abs, step)), far, k, int(entry)))
        chosen[i] = best[3] if best else int(((entries.astype(np.int64) - centre(bins[i])) ** 2).sum(1).argmin())
        if compat:
            slot[bins[i]] = chosen[i]
    return entries, bins[order], chosen[at]


def bounds(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(xyz):
        return np.zeros(3, F32), np.zeros(3, F32)
    return xyz.min(0).astype(F32), xyz.max(0).astype(F32)


def quantise(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: int) -> np.ndarray:
    """Codes (n, 3) in 32-bit arithmetic."""
    top = F32((1 << b) - 1)
    span = (hi - lo).astype(F32)
    with np.errstate(divide="ignore"):
        scale = np.where(span > EPS, top / np.where(span > EPS, span, F32(1)), F32(0)).astype(F32)
    code = np.floor((v.astype(F32) - lo.astype(F32)) * scale + F32(0.5)).astype(np.float64)
    return np.where(scale == 0, 0, np.clip(code, 0, (1 << b) - 1)).astype(np.uint64)


def dequantise(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: int) -> np.ndarray:
    span = (hi - lo).astype(F32)
    step = (span / F32((1 << b) - 1)).astype(F32)
    return np.where(span > 0, (code * step.astype(np.float64) + lo.astype(np.float64)).astype(F32), lo)


def encode(cloud: Cloud, p: Quantize) -> bytes:
    n, xyz, rgb = len(cloud), cloud.xyz, cloud.rgb
    if not np.isfinite(xyz).all():
        raise CodecError("positions must be finite")
    pb, cb = min(max(p.position_bits, 1), 32), min(max(p.color_bits, 1), 32)
    lo, hi = bounds(xyz)
    clo, chi = (rgb.min(0), rgb.max(0)) if n else (np.zeros(3, np.uint8), np.zeros(3, np.uint8))
    wide, colour = [width_of(pb, p.pack_positions)] * 3, [width_of(cb, p.pack_colors)] * 3
    palette = None
    if p.max_palette_colors > 0 and n and palette_wins(n, sum(wide), sum(colour), p.max_palette_colors, p.pack_colors):
        palette, _, index = palette_of(rgb, p.max_palette_colors)
        if len(palette) > 0xFFFF:
            raise CodecError("the palette is too long")
        cb = index_width(len(palette))
        colour, codes = [width_of(cb, p.pack_colors)], [index.astype(np.uint64)]
    elif cb == 8 and not clo.any() and (chi == 255).all():
        codes = [rgb[:, c].astype(np.uint64) for c in range(3)]
    else:
        codes = list(quantise(rgb, clo, chi, cb).T)
    positions = list(quantise(xyz, lo, hi, pb).T) if n else [np.zeros(0, np.uint64)] * 3
    if p.delta_positions:
        positions = [_delta(c, pb) for c in positions]
    if p.delta_colors:
        codes = [_delta(c, cb) for c in codes]
    flags = DELTA_POSITIONS * p.delta_positions | DELTA_COLOURS * p.delta_colors | WIDE_POSITIONS * (not p.pack_positions) | WIDE_COLOURS * (not p.pack_colors)
    head = MAGIC + bytes([2, pb, cb & BITS_MASK | HAS_PALETTE * (palette is not None) | HAS_FLAGS * bool(flags)])
    head += bytes([flags]) if flags else b""
    head += struct.pack("<I6f", n, *lo, *hi) + clo.tobytes() + chi.tobytes()
    if palette is not None:
        head += struct.pack("<H", len(palette)) + palette.tobytes()
    return head + bits.pack([*positions, *codes], [*wide, *colour])


def _delta(code: np.ndarray, b: int) -> np.ndarray:
    return np.diff(code.astype(np.int64), prepend=0).astype(np.uint64) & np.uint64((1 << b) - 1)


def _undelta(code: np.ndarray, b: int) -> np.ndarray:
    return np.cumsum(code, dtype=np.uint64) & np.uint64((1 << b) - 1)


def decode(data: bytes) -> Cloud:
    c = Cursor(data)
    c.magic(MAGIC)
    (version,) = c.unpack("B")
    flags, has_palette = 0, False
    if version == 1:
        (pb,) = c.unpack("B")
        cb = pb
    elif version == 2:
        pb, raw = c.unpack("BB")
        cb, has_palette = raw & BITS_MASK, bool(raw & HAS_PALETTE)
        if raw & HAS_FLAGS:
            (flags,) = c.unpack("B")
    else:
        raise FormatError(f"unknown version {version}")
    if not 1 <= pb <= 32 or cb > 32 or cb == 0 and not has_palette:
        raise FormatError("bits out of range")
    n, *box = c.unpack("I6f")
    lo, hi = np.array(box[:3], F32), np.array(box[3:], F32)
    clo, chi = (np.frombuffer(c.take(3), np.uint8) for _ in range(2))
    palette = None
    if has_palette:
        (k,) = c.unpack("H")
        if not k:
            raise FormatError("an empty palette")
        palette = np.frombuffer(c.take(3 * k), np.uint8).reshape(k, 3)
    wide = [width_of(pb, not flags & WIDE_POSITIONS)] * 3
    colour = [width_of(cb, not flags & WIDE_COLOURS)] * (1 if has_palette else 3)
    body = c.take(-(-n * sum(wide + colour) // 8))
    fields = bits.unpack(body, n, wide + colour)
    positions, codes = fields[:3], fields[3:]
    if flags & DELTA_POSITIONS:
        positions = [_undelta(v, pb) for v in positions]
    if flags & DELTA_COLOURS:
        codes = [_undelta(v, cb) for v in codes]
    xyz = dequantise(np.stack(positions, axis=1).astype(np.float64), lo, hi, pb)
    if palette is not None:
        index = codes[0].astype(np.int64)
        if n and index.max() >= len(palette):
            raise FormatError("palette index out of range")
        rgb = palette[index]
    else:
        code = np.stack(codes, axis=1).astype(np.float64)
        step = ((chi.astype(F32) - clo.astype(F32)) / F32((1 << cb) - 1)).astype(F32)
        rgb = np.clip(np.floor(code * step.astype(np.float64) + clo + 0.5), 0, 255).astype(np.uint8)
    return Cloud(xyz.astype(F32), rgb)
