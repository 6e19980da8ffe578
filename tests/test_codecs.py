"""Byte layouts: round trips, sizes and malformed input."""

import numpy as np
import pytest

from cloudloom import params as P
from cloudloom.errors import CodecError, FeatureDisabled, FormatError, UnsupportedKind
from cloudloom.sources import bits, planes, ply, quantised, registry, wrap
from cloudloom.sources.cloud import Cloud

SMOKE = Cloud(
    np.array([[0, 0, 0], [1, 2, 3], [-4, 5, -6], [10, -2.5, 0.125]], np.float32), np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [123, 45, 67]], np.uint8)
)
SPLAT = Cloud(
    np.array([[1, 2, 3]], np.float32), np.array([[128, 64, 32]], np.uint8), np.array([200], np.uint8), np.array([[0.5, 1.25, 2]], np.float32), np.array([[0.70710677, 0, 0.70710677, 0]], np.float32)
)


def lcg_cloud(n):
    s, out = 1, []
    for _ in range(n):
        row = []
        for _ in range(4):
            s = (s * 1664525 + 1013904223) % 2**32
            row.append(s)
        out.append(row)
    a = np.array(out, np.float64)
    c = (a[:, 3].astype(np.int64) & 255).astype(np.uint8)
    xyz = a[:, :3] / 2**32 * [10, 3, 100] + [-5, -1.5, 0]
    return Cloud(xyz.astype(np.float32), np.stack([c, c, c], 1))


@pytest.mark.parametrize("p", [P.Bitcode(), P.Ply(), P.Ply("Ascii"), P.Ply("BinaryBigEndian"), P.Gzip(), P.Zstd(P.Ply(), 3), P.Lz4(), P.Snappy(P.Gzip())], ids=P.label)
def test_lossless(p):
    back = registry.decode(registry.encode(SMOKE, p))
    assert (back.xyz == SMOKE.xyz).all() and (back.rgb == SMOKE.rgb).all()
    assert registry.chain_of(registry.encode(SMOKE, p)) == P.chain(p)[: len(registry.chain_of(registry.encode(SMOKE, p)))]


def test_quantised_tolerance_and_size():
    unit = Cloud(np.array([[0, 0, 0], [0.5, 0.75, 0.25], [1, 1, 1]], np.float32), np.array([[10, 20, 30], [40, 50, 60], [70, 80, 90]], np.uint8))
    back = registry.decode(registry.encode(unit, P.Quantize()))
    assert np.abs(back.xyz - unit.xyz).max() < 1e-3 and np.abs(back.rgb.astype(int) - unit.rgb).max() <= 1
    two = Cloud(np.array([[1, 2, 3], [-1, -2, -3]], np.float32), np.array([[64, 128, 255], [0, 32, 64]], np.uint8))
    assert len(registry.encode(two, P.Quantize(10, 5))) == 40 + -(-2 * 45 // 8)


def test_quantised_delta_unpacked():
    i = np.arange(16)
    c = Cloud(np.stack([0.25 * i, np.sin(i), np.cos(i)], 1).astype(np.float32), np.stack([11 * i % 256, 17 * i % 256, 23 * i % 256], 1).astype(np.uint8))
    data = registry.encode(c, P.Quantize(13, 7, 0, True, True, False, False))
    assert data[6] == 15 and np.abs(registry.decode(data).xyz - c.xyz).max() < 5e-3


def test_palette():
    rgb = np.array([[10, 20, 30]] * 100 + [[200, 10, 10]] * 10 + [[10, 200, 10]] * 10, np.uint8)
    entries, _, index = quantised.palette_of(rgb, 2)
    assert entries[0].tolist() == [10, 20, 30] and index.max() < 2 and (index[:100] == 0).all()
    big = Cloud(np.random.default_rng(0).normal(size=(5000, 3)).astype(np.float32), np.repeat(np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]], np.uint8), 1250, axis=0))
    data = registry.encode(big, P.Quantize(12, 8, 4))
    assert data[5] & 0x80 and (registry.decode(data).rgb == big.rgb).all()


def test_empty_clouds():
    empty = Cloud(np.zeros((0, 3), np.float32), np.zeros((0, 3), np.uint8))
    for p in (P.Bitcode(), P.Ply(), P.Ply("Ascii"), P.Quantize(), P.Gsplat16(), P.Gzip()):
        assert len(registry.decode(registry.encode(empty, p))) == 0
    with pytest.raises(CodecError):
        registry.encode(empty, P.Sogp())


@pytest.mark.parametrize("p", [P.Sogp(), P.Sogp(packed_stream=False, compression="None"), P.Sogp(compression="Snappy"), P.Sogp(compression={"kind": "lz4"})])
def test_planes_of_many(p):
    c = lcg_cloud(5000)
    back = registry.decode(registry.encode(c, p))
    span = (c.xyz.max(0) - c.xyz.min(0)) / 65535
    order = planes.morton_order(c.xyz, c.xyz.min(0), c.xyz.max(0))
    assert (np.abs(back.xyz - c.xyz[order]) <= span).all() and (back.rgb == c.rgb[order]).all()


def test_half_float_records():
    back = registry.decode(registry.encode(SPLAT, P.Gsplat16()))
    assert np.abs(back.xyz - SPLAT.xyz).max() < 1e-2 and back.rgb.tolist() == SPLAT.rgb.tolist() and back.alpha.tolist() == [200]
    assert (np.abs(back.scale - SPLAT.scale) <= np.maximum(0.02, 0.05 * SPLAT.scale)).all()
    assert abs(float((back.rotation * SPLAT.rotation).sum())) > 0.98
    with pytest.raises(CodecError):
        registry.encode(Cloud(np.array([[70000.0, 0, 0]], np.float32), np.zeros((1, 3), np.uint8)), P.Gsplat16())


def test_wide_half_float_records():
    largest = float(np.float32(2.0**128 - 2.0**117))  # eleven bits, all set
    far = np.array([[65519.99, 65520, -70000], [89999, 2.0**24 + 2, 1e30], [largest, 1e-7, 0], [0.1, -6e-8, 3]], np.float32)
    want = [[65504, 65536, -70016], [89984, 2.0**24, None], [largest, None, 0], [None, None, 3]]
    for xyz in (far, far.astype(np.float64)):
        data = registry.encode(Cloud(xyz, np.zeros((4, 3), np.uint8)), P.Gsplat16(True))
        back = registry.decode(data).xyz
        assert len(data) == 16 + 16 * 4 and data[3] == 2 and back.dtype == np.float32
        assert all(w is None or w == b for w, b in zip(sum(want, []), back.ravel().tolist(), strict=True))
        assert (np.abs(back - far) <= np.maximum(np.abs(far.astype(np.float64)) * 2.0**-11, 2.0**-25)).all()
    assert registry.encode(SMOKE, P.Gsplat16(True)) == registry.encode(SMOKE, P.Gsplat16())
    for value in (np.inf, np.nan, 3.402e38):
        with pytest.raises(CodecError):
            registry.encode(Cloud(np.array([[0, value, 0]], np.float32), np.zeros((1, 3), np.uint8)), P.Gsplat16(True))
    splat = Cloud(SPLAT.xyz * np.float32(1e5), SPLAT.rgb, SPLAT.alpha, SPLAT.scale, SPLAT.rotation)
    with pytest.raises(CodecError):
        registry.encode(splat, P.Gsplat16(True))
    with pytest.raises(FormatError):
        registry.decode(b"GSP\x02" + registry.encode(SPLAT, P.Gsplat16())[4:])


def test_ply_splats_and_alpha():
    for e in ("Ascii", "BinaryLittleEndian", "BinaryBigEndian"):
        back = registry.decode(registry.encode(SPLAT, P.Ply(e)))
        assert np.abs(back.xyz - SPLAT.xyz).max() < 1e-4 and np.abs(back.scale - SPLAT.scale).max() < 2e-3
        assert np.abs(back.rgb.astype(int) - SPLAT.rgb).max() <= 1 and abs(int(back.alpha[0]) - 200) <= 1
        rgba = Cloud(SMOKE.xyz, SMOKE.rgb, np.array([1, 2, 128, 255], np.uint8))
        back = registry.decode(registry.encode(rgba, P.Ply(e)))
        assert back.alpha.tolist() == [1, 2, 128, 255] and (back.xyz == rgba.xyz).all()


def test_ply_lists_and_other_elements():
    text = "ply\nformat ascii 1.0\ncomment hello\nelement face 1\nproperty list uchar int vertex_indices\nelement vertex 2\nproperty float y\nproperty double x\nproperty float z\nend_header\n3 0 1 2\n1 2 3\n4 5 6\n"
    back = ply.decode(text.encode())
    assert back.xyz.tolist() == [[2, 1, 3], [5, 4, 6]] and back.rgb.tolist() == [[0, 0, 0]] * 2
    head = "ply\nformat binary_little_endian 1.0\nelement face 1\nproperty list uchar int v\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    data = head.encode() + b"\x02" + np.array([7, 8], "<i4").tobytes() + np.array([1, 2, 3], "<f4").tobytes()
    assert ply.decode(data).xyz.tolist() == [[1, 2, 3]]


@pytest.mark.parametrize("data", [b"", b"ab", b"???xx", b"QNT", b"QNT\x03", b"SGP\x01", b"plx\n", b"ply\nno end", b"GSP\x01" + b"\0" * 5, b"GZPxx", b"ZSTxx", b"LZ4xx", b"SNPxx", b"BC1\0\0\0\0"])
def test_malformed(data):
    with pytest.raises(FormatError):
        registry.decode(data)


def test_empty_palette_is_refused():
    data = b"QNT\x02\x0c\x80" + b"\0" * 34 + b"\0\0"
    with pytest.raises(FormatError):
        registry.decode(data)


def test_disabled_formats():
    for magic in (b"DRAxx", b"TMFxx", b"OZLxx"):
        with pytest.raises(FeatureDisabled):
            registry.decode(magic)
    with pytest.raises(FeatureDisabled):
        registry.encode(SMOKE, P.Draco())
    with pytest.raises(CodecError):
        registry.encode(SMOKE, P.LASzip())


def test_kinds_and_chains():
    with pytest.raises(UnsupportedKind) as e:
        registry.encode(SPLAT, P.Snappy(P.Quantize()))
    assert e.value.chain == ["Snappy", "Quantize"]
    assert P.chain(P.Snappy(P.Gzip())) == ["Snappy", "Gzip", "Bitcode"] and P.label(P.Gzip(P.Ply())) == "gzip+ply"
    assert P.holds(P.Gzip(P.Zstd(P.Bitcode())), "splats") and not P.holds(P.Sogp(), "splats")
    assert P.format_name("gsp") == "GSP16" and P.format_name("nothing") is None and P.is_wrapper(P.Lz4()) and not P.is_wrapper(P.Ply())


def test_parameters():
    p = P.from_toml('params = { Zstd = { level = 3, inner = { Quantize = { position_bits = 16 } } } }')
    assert p == P.Zstd(P.Quantize(16), 3)
    assert P.from_toml("[Ply]\nencoding = 'Ascii'\nascii_float_mode = { Fixed = 3 }") == P.Ply("Ascii", ascii_float_mode=3)
    for bad in ("x = 1", "[Quantize]\nnothing = 1", "[Sogp]\npos_bits = 17"):
        with pytest.raises(CodecError):
            P.from_toml(bad)
    assert P.defaults("GZIP") == P.Gzip(P.Bitcode())


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 13, 32])
def test_bits(width):
    v = np.array([0, 1, 3, 7, 0xFF, 0x12345678, 0xDEADBEEF, 0xFFFFFFFF], np.uint64) & np.uint64((1 << width) - 1)
    data = bits.pack([v, v], [width, 5])
    back = bits.unpack(data, len(v), [width, 5])
    assert (back[0] == v).all() and (back[1] == v & np.uint64(31)).all() and len(data) == -(-len(v) * (width + 5) // 8)
    with pytest.raises(FormatError):
        bits.unpack(data[:-1], len(v), [width, 5])


@pytest.mark.parametrize("name", ["Gzip", "Zstd", "Lz4", "Snappy"])
def test_compression(name):
    for data in (b"", b"a", b"abc" * 50_000, np.random.default_rng(0).bytes(70_000)):
        assert wrap.unpack(name, wrap.pack(name, data)) == data
    with pytest.raises(FormatError):
        wrap.unpack(name, wrap.pack(name, b"abc" * 1000)[:-3])
    assert wrap.crc32c(b"123456789") == 0xE3069283
