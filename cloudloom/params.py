"""Codec parameters: a tree of frozen dataclasses, read from dictionaries or TOML."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from typing import Any

from .errors import CodecError, UnsupportedKind


@dataclass(frozen=True)
class Params:
    """Base of all parameters; ``inner`` marks wrappers."""

    @property
    def inner_params(self) -> Params | None:
        return getattr(self, "inner", None)


@dataclass(frozen=True)
class Ply(Params):
    encoding: str = "BinaryLittleEndian"
    coord_scalar: str = "Float"
    write_color: bool = True
    write_alpha: bool | None = None
    comments: tuple[str, ...] = ()
    ascii_float_mode: str | int = "Shortest"

    def __post_init__(self) -> None:
        if self.encoding not in ("Ascii", "BinaryLittleEndian", "BinaryBigEndian"):
            raise CodecError(f"unknown PLY encoding {self.encoding}")
        if self.coord_scalar not in ("Float", "Double"):
            raise CodecError("coord_scalar must be Float or Double")


@dataclass(frozen=True)
class Draco(Params):
    method: str = "KdTree"
    config: Any = None


@dataclass(frozen=True)
class Gsplat16(Params):
    wide_positions: bool = False


@dataclass(frozen=True)
class Tmf(Params):
    pass


@dataclass(frozen=True)
class Bitcode(Params):
    pass


@dataclass(frozen=True)
class Quantize(Params):
    position_bits: int = 12
    color_bits: int = 8
    max_palette_colors: int = 0
    delta_positions: bool = False
    delta_colors: bool = False
    pack_positions: bool = True
    pack_colors: bool = True


@dataclass(frozen=True)
class LASzip(Params):
    pass


@dataclass(frozen=True)
class Gzip(Params):
    inner: Params = field(default_factory=Bitcode)
    level: int | None = None


@dataclass(frozen=True)
class Zstd(Params):
    inner: Params = field(default_factory=Bitcode)
    level: int | None = None


@dataclass(frozen=True)
class Lz4(Params):
    inner: Params = field(default_factory=Bitcode)


@dataclass(frozen=True)
class Snappy(Params):
    inner: Params = field(default_factory=Bitcode)


@dataclass(frozen=True)
class Sogp(Params):
    pos_bits: int = 16
    morton_order: bool = True
    include_color: bool = True
    packed_stream: bool = True
    compression: Any = "Zstd"

    def __post_init__(self) -> None:
        if not 1 <= self.pos_bits <= 16:
            raise CodecError("pos_bits must be 1..16")


@dataclass(frozen=True)
class Openzl(Params):
    mode: str = "serial"
    inner: Params | None = None
    pack_rgb: bool = True


#: Fixed names of the formats, as they are shown, and the spellings that are understood.
KINDS: dict[str, type[Params]] = {
    "PLY": Ply, "Draco": Draco, "GSP16": Gsplat16, "LASzip": LASzip, "TMF": Tmf, "Bitcode": Bitcode, "Gzip": Gzip,
    "Zstd": Zstd, "Lz4": Lz4, "Snappy": Snappy, "SOGP": Sogp, "Quantize": Quantize, "OpenZL": Openzl,
}
SPELLINGS = {name.lower(): name for name in KINDS} | {"gsplat16": "GSP16", "gsp": "GSP16"}
WRAPPERS = (Gzip, Zstd, Lz4, Snappy)
HOLD_SPLATS = (Ply, Gsplat16, Bitcode)


def format_name(text: str) -> str | None:
    """The shown name of a format, from any spelling."""
    return SPELLINGS.get(text.lower())


def name_of(p: Params) -> str:
    return next(name for name, kind in KINDS.items() if type(p) is kind)


def defaults(name: str) -> Params:
    """Default parameters by format; wrappers wrap Bitcode."""
    shown = format_name(name)
    if shown is None:
        raise CodecError(f"unknown format {name}")
    if shown == "LASzip":
        raise CodecError("LASzip is not implemented")
    return KINDS[shown]()


def is_wrapper(p: Params) -> bool:
    return isinstance(p, WRAPPERS) or isinstance(p, Openzl) and p.mode == "serial" and p.inner is not None


def chain(p: Params) -> list[str]:
    """Format names from the outermost to the innermost."""
    return [name_of(p), *(chain(p.inner_params) if p.inner_params is not None else [])]


def label(p: Params) -> str:
    return "+".join(n.lower() for n in chain(p))


def holds(p: Params, kind: str) -> bool:
    if not kind.startswith("splats") or isinstance(p, HOLD_SPLATS):
        return True
    return p.inner_params is not None and holds(p.inner_params, kind)


def validate(p: Params, kind: str) -> None:
    """Raises where the chain can't hold the kind."""
    if not holds(p, kind):
        raise UnsupportedKind("Splats" if kind.startswith("splats") else "Points", "Rgb8" if kind == "points" else "Rgba8", chain(p))


def parse(tree: Any) -> Params:
    """Parameters from a name, or from ``{Name: {fields}}``; unknown names and fields raise."""
    name, body = (tree, {}) if isinstance(tree, str) else next(iter(tree.items())) if isinstance(tree, dict) and len(tree) == 1 else (None, None)
    shown = format_name(name) if name else None
    if shown is None:
        raise CodecError(f"not codec parameters: {tree!r}")
    kind = KINDS[shown]
    known = {f.name for f in dataclasses.fields(kind)}
    body = dict(body or {})
    if extra := set(body) - known:
        raise CodecError(f"unknown fields of {shown}: {sorted(extra)}")
    if body.get("inner") is not None:
        body["inner"] = parse(body["inner"])
    if "comments" in body:
        body["comments"] = tuple(body["comments"])
    if isinstance(body.get("ascii_float_mode"), dict):
        body["ascii_float_mode"] = int(body["ascii_float_mode"]["Fixed"])
    return kind(**{k: v for k, v in body.items() if v is not None or k == "write_alpha"})


def from_toml(text: str) -> Params:
    """One of three shapes: ``params = ...``, ``[encoding] ...`` with a params key inside, or the bare table."""
    tree = tomllib.loads(text)
    for key in ("params", "encoding"):
        if set(tree) == {key}:
            tree = tree[key]
    return parse(tree)
