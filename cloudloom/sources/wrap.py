"""Byte-to-byte compression, and the wrapper payloads made of it."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
import zstandard

from ..errors import FormatError

GZIP_LEVEL, ZSTD_LEVEL = 6, 1
MAGIC = {"Gzip": b"GZP", "Zstd": b"ZST", "Lz4": b"LZ4", "Snappy": b"SNP"}
#: The stream identifier chunk of the Snappy framing format.
SNAPPY_START = b"\xff\x06\x00\x00sNaPpY"
#: Most that any payload may unpack to.
LIMIT = 2 << 30


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _CRC[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


def _masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def snappy_frame(data: bytes) -> bytes:
    out = [SNAPPY_START]
    for i in range(0, len(data), 1 << 16):
        part = data[i : i + (1 << 16)]
        packed = pa.compress(part, codec="snappy", asbytes=True)
        small = len(packed) < len(part) - len(part) // 8
        body = struct.pack("<I", _masked(part)) + (packed if small else part)
        out.append(struct.pack("<I", (0x00 if small else 0x01) | len(body) << 8) + body)
    return b"".join(out)


def snappy_unframe(data: bytes) -> bytes:
    if not data.startswith(SNAPPY_START):
        raise FormatError("not a Snappy stream")
    at, out = len(SNAPPY_START), []
    while at < len(data):
        if at + 4 > len(data):
            raise FormatError("Snappy chunk is cut off")
        head = struct.unpack_from("<I", data, at)[0]
        kind, n = head & 0xFF, head >> 8
        body = data[at + 4 : at + 4 + n]
        if len(body) < n:
            raise FormatError("Snappy chunk is cut off")
        at += 4 + n
        if kind in (0, 1):
            plain = body[4:]
            if kind == 0:
                size = shift = used = 0
                while True:
                    b = plain[used]
                    size |= (b & 0x7F) << shift
                    used, shift = used + 1, shift + 7
                    if not b & 0x80:
                        break
                plain = pa.decompress(plain, decompressed_size=size, codec="snappy", asbytes=True) if size else b""
            if struct.unpack("<I", body[:4])[0] != _masked(plain):
                raise FormatError("Snappy checksum differs")
            out.append(plain)
        elif kind < 0x80:
            raise FormatError(f"Snappy chunk of unknown kind {kind}")
    return b"".join(out)


def pack(name: str, data: bytes, level: int | None = None) -> bytes:
    if name == "Gzip":
        c = zlib.compressobj(GZIP_LEVEL if level is None else level, wbits=31)
        return c.compress(data) + c.flush()
    if name == "Zstd":
        return zstandard.ZstdCompressor(level=ZSTD_LEVEL if level is None else level).compress(data)
    if name == "Lz4":
        return pa.compress(data, codec="lz4", asbytes=True)
    if name == "Snappy":
        return snappy_frame(data)
    raise FormatError(f"unknown compression {name}")


def unpack(name: str, data: bytes, limit: int = LIMIT) -> bytes:
    try:
        if name == "Gzip":
            d = zlib.decompressobj(wbits=31)
            out = d.decompress(data, limit)
            if d.unconsumed_tail or not d.eof:
                raise FormatError("gzip stream is cut off or too large")
            return out
        if name == "Zstd":
            if zstandard.frame_content_size(data) > limit:
                raise FormatError("zstd stream is too large")
            d = zstandard.ZstdDecompressor().decompressobj()
            out = d.decompress(data)
            if not d.eof or len(out) > limit:
                raise FormatError("zstd stream is cut off or too large")
            return out
        if name == "Lz4":
            with pa.CompressedInputStream(pa.BufferReader(data), "lz4") as r:
                out = r.read(limit)
                if r.read(1):
                    raise FormatError("lz4 stream is too large")
                return out
        if name == "Snappy":
            return snappy_unframe(data)
    except (zlib.error, zstandard.ZstdError, pa.ArrowException, OSError, IndexError) as e:
        raise FormatError(f"{name}: {e}") from e
    raise FormatError(f"unknown compression {name}")
