"""PLY files: header, text and binary bodies, points and splats."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..errors import FormatError
from ..functions.splat import SH_C0
from ..params import Ply
from .cloud import Cloud

#: Fixed values of the format: scalar types with their spellings, in numpy's notation.
SCALARS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
ENCODINGS = {"Ascii": "ascii", "BinaryLittleEndian": "binary_little_endian", "BinaryBigEndian": "binary_big_endian"}
SPLAT_NAMES = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "rot_0", "rot_1", "rot_2", "rot_3", "scale_0", "scale_1", "scale_2"]
CHANNELS = {"r": ("red", "r"), "g": ("green", "g"), "b": ("blue", "b"), "a": ("alpha", "a", "opacity")}


@dataclass
class Property:
    name: str
    kind: str
    count: str | None = None  # the type of a list's length


@dataclass
class Element:
    name: str
    size: int
    properties: list[Property] = field(default_factory=list)


@dataclass
class Header:
    encoding: str
    elements: list[Element]
    comments: list[str]
    end: int  # where the body begins

    @property
    def vertex(self) -> Element:
        for e in self.elements:
            if e.name == "vertex":
                return e
        raise FormatError("no vertex element")


def _scalar(name: str) -> str:
    if name.lower() not in SCALARS:
        raise FormatError(f"unknown scalar type {name}")
    return SCALARS[name.lower()]


def read_header(data: bytes) -> Header:
    """Unknown lines are skipped; the format is text where none is given."""
    at, lines = 0, []
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise FormatError("PLY header doesn't end")
        line = data[at:end].decode("latin-1").strip()
        at = end + 1
        lines.append(line)
        if line == "end_header":
            break
        if lines[0] != "ply":
            raise FormatError("not a PLY file")
    encoding, elements, comments = "ascii", [], []
    for line in lines[1:-1]:
        word, _, rest = line.partition(" ")
        parts = rest.split()
        if word == "format" and parts:
            encoding = parts[0]
        elif word in ("comment", "obj_info"):
            comments.append(rest)
        elif word == "element" and len(parts) == 2:
            elements.append(Element(parts[0], int(parts[1])))
        elif word == "property" and elements:
            if parts[:1] == ["list"] and len(parts) == 4:
                elements[-1].properties.append(Property(parts[3], _scalar(parts[2]), _scalar(parts[1])))
            elif len(parts) == 2:
                elements[-1].properties.append(Property(parts[1], _scalar(parts[0])))
    if encoding not in ENCODINGS.values():
        raise FormatError(f"unknown PLY format {encoding}")
    return Header(encoding, elements, comments, at)


def header_text(encoding: str, properties: list[tuple[str, str]], n: int, comments: tuple[str, ...] = ()) -> str:
    lines = ["ply", f"format {ENCODINGS[encoding]} 1.0", *(f"comment {c}" for c in comments), f"element vertex {n}", *(f"property {kind} {name}" for name, kind in properties), "end_header"]
    return "\n".join(lines) + "\n"


def unit_bytes(v: np.ndarray, compat: bool) -> np.ndarray:
    """Shares 0..1 as bytes; values outside are clamped, or with compat, bytes already where above 1."""
    v = np.nan_to_num(v.astype(np.float64), nan=0.0)
    out = np.floor(v * 255 + 0.5)
    if compat:
        out = np.where((v >= 0) & (v <= 1), out, np.floor(v + 0.5))
    return np.clip(out, 0, 255).astype(np.uint8)


def _colour(v: np.ndarray) -> np.ndarray:
    return unit_bytes(v, True) if v.dtype.kind == "f" else np.clip(v, 0, 255).astype(np.uint8)


def _cloud(columns: dict[str, np.ndarray], compat: bool) -> Cloud:
    if not {"x", "y", "z"} <= set(columns):
        raise FormatError("PLY vertices without x, y and z")
    wide = any(columns[c].dtype == np.float64 for c in "xyz")
    xyz = np.stack([columns[c] for c in "xyz"], axis=1).astype(np.float64 if wide else np.float32)
    n = len(xyz)
    if set(SPLAT_NAMES) <= set(columns):
        get = lambda *names: np.stack([columns[c].astype(np.float64) for c in names], axis=1)
        rgb = unit_bytes(SH_C0 * get("f_dc_0", "f_dc_1", "f_dc_2") + 0.5, compat)
        opacity = columns["opacity"].astype(np.float64)
        e = np.exp(-np.abs(opacity))
        alpha = unit_bytes(np.where(opacity >= 0, 1 / (1 + e), e / (1 + e)), compat)
        scale = np.exp(get("scale_0", "scale_1", "scale_2")).astype(np.float32)
        return Cloud(xyz.astype(np.float32), rgb, alpha, scale, get("rot_0", "rot_1", "rot_2", "rot_3").astype(np.float32))
    found = {c: next((n for n in names if n in columns), None) for c, names in CHANNELS.items()}
    if not all(found[c] for c in "rgb"):
        return Cloud(xyz, np.zeros((n, 3), np.uint8))
    rgb = np.stack([_colour(columns[found[c]]) for c in "rgb"], axis=1)
    return Cloud(xyz, rgb, _colour(columns[found["a"]]) if found["a"] else None)


def decode(data: bytes, compat: bool = False) -> Cloud:
    """The vertices; other elements and list properties are skipped. compat: splat colours above 1 count as bytes."""
    h = read_header(data)
    columns = (_text if h.encoding == "ascii" else _binary)(data, h)
    return _cloud(columns, compat)


def _text(data: bytes, h: Header) -> dict[str, np.ndarray]:
    lines = data[h.end :].decode("latin-1").split("\n")
    at = 0
    for e in h.elements:
        if e.name != "vertex":
            at += e.size
            continue
        rows = [line.split() for line in lines[at : at + e.size]]
        if len(rows) < e.size:
            raise FormatError("PLY text is cut off")
        out: dict[str, np.ndarray] = {}
        try:
            if not any(p.count for p in e.properties):
                for i, p in enumerate(e.properties):
                    out[p.name] = np.array([r[i] for r in rows], dtype=np.float64).astype(p.kind)
                return out
            values: dict[str, list[float]] = {p.name: [] for p in e.properties if not p.count}
            for r in rows:
                i = 0
                for p in e.properties:
                    if p.count:
                        i += 1 + int(r[i])
                    else:
                        values[p.name].append(float(r[i]))
                        i += 1
            return {p.name: np.array(values[p.name]).astype(p.kind) for p in e.properties if not p.count}
        except (IndexError, ValueError) as e2:
            raise FormatError(f"PLY text: {e2}") from e2
    raise FormatError("no vertex element")


def _binary(data: bytes, h: Header) -> dict[str, np.ndarray]:
    order = "<" if h.encoding == "binary_little_endian" else ">"
    at = h.end
    for e in h.elements:
        if not any(p.count for p in e.properties):
            row = np.dtype([(p.name, order + p.kind) for p in e.properties])
            end = at + row.itemsize * e.size
            if end > len(data):
                raise FormatError("PLY body is cut off")
            if e.name == "vertex":
                rows = np.frombuffer(data[at:end], row)
                return {p.name: rows[p.name].astype(p.kind) for p in e.properties}
            at = end
            continue
        values: dict[str, list] = {p.name: [] for p in e.properties if not p.count}
        for _ in range(e.size):
            for p in e.properties:
                kinds = [p.count, p.kind] if p.count else [p.kind]
                for k, kind in enumerate(kinds):
                    item = np.dtype(order + kind)
                    n = int(length) if k else 1  # noqa: F821
                    if at + item.itemsize * n > len(data):
                        raise FormatError("PLY body is cut off")
                    got = np.frombuffer(data, item, n, at)
                    at += item.itemsize * n
                    if p.count and not k:
                        length = got[0]
                    elif not p.count:
                        values[p.name].append(got[0])
        if e.name == "vertex":
            return {p.name: np.array(values[p.name]).astype(p.kind) for p in e.properties if not p.count}
    raise FormatError("no vertex element")


def splat_fields(cloud: Cloud) -> np.ndarray:
    """The 14 values of every splat, in the order of SPLAT_NAMES."""
    alpha = np.clip(cloud.alpha / 255.0, 1e-6, 1 - 1e-6)
    scale = cloud.scale.astype(np.float64)
    usable = np.isfinite(scale) & (scale > 0)
    rotation = cloud.rotation.astype(np.float64)
    return np.concatenate(
        [
            cloud.xyz.astype(np.float64),
            (cloud.rgb / 255.0 - 0.5) / SH_C0,
            np.log(alpha / (1 - alpha))[:, None],
            np.where(np.isfinite(rotation), rotation, [1.0, 0, 0, 0]),
            np.log(np.where(usable, scale, 1.0)),
        ],
        axis=1,
    )


def _spelt(v: float, kind: type, mode: str | int) -> str:
    if isinstance(mode, int):
        return f"{float(kind(v)):.{mode}f}"
    return np.format_float_positional(kind(v), unique=True, trim="-")


def encode(cloud: Cloud, p: Ply) -> bytes:
    scalar, form = ("double", "f8") if p.coord_scalar == "Double" else ("float", "f4")
    kind = np.float64 if form == "f8" else np.float32
    if cloud.scale is not None:
        names, bytes_ = SPLAT_NAMES, []
        floats = splat_fields(cloud)
    else:
        alpha = cloud.alpha is not None if p.write_alpha is None else p.write_alpha
        names = ["x", "y", "z"]
        bytes_ = ["red", "green", "blue"] * p.write_color + ["alpha"] * (p.write_color and alpha)
        floats = cloud.xyz
    colours = cloud.rgb
    if "alpha" in bytes_:
        colours = np.concatenate([cloud.rgb, (np.full(len(cloud), 255, np.uint8) if cloud.alpha is None else cloud.alpha)[:, None]], axis=1)
    head = header_text(p.encoding, [*((n, scalar) for n in names), *((n, "uchar") for n in bytes_)], len(cloud), p.comments)
    if p.encoding == "Ascii":
        lines = []
        for i, row in enumerate(floats):
            parts = [_spelt(v, kind, p.ascii_float_mode) for v in row]
            if bytes_:
                parts += map(str, colours[i].tolist())
            lines.append(" ".join(parts) + "\n")
        return (head + "".join(lines)).encode()
    order = "<" if p.encoding == "BinaryLittleEndian" else ">"
    rows = np.zeros(len(cloud), np.dtype([("f", order + form, len(names)), ("c", "u1", len(bytes_))]))
    rows["f"] = floats
    if bytes_:
        rows["c"] = colours
    return head.encode() + rows.tobytes()
