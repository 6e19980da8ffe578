"""Front door of the codecs: parameters to bytes, and bytes of any kind to a cloud."""

from __future__ import annotations

from collections.abc import Callable

from .. import params as P
from ..errors import CodecError, FeatureDisabled, FormatError
from . import lossless, planes, ply, quantised, records, wrap
from .cloud import Cloud

ENCODERS: dict[type[P.Params], Callable[[Cloud, P.Params], bytes]] = {P.Ply: ply.encode, P.Bitcode: lossless.encode, P.Quantize: quantised.encode, P.Sogp: planes.encode, P.Gsplat16: records.encode}
DECODERS: dict[bytes, Callable[[bytes], Cloud]] = {b"ply": ply.decode, lossless.MAGIC: lossless.decode, quantised.MAGIC: quantised.decode, planes.MAGIC: planes.decode, records.MAGIC: records.decode}
#: Formats whose bytes are known by sight, but whose libraries aren't here.
DISABLED = {b"DRA": "Draco", b"TMF": "TMF", b"OZL": "OpenZL"}
WRAPPED = {magic: name for name, magic in wrap.MAGIC.items()}
MAGICS = {b"ply": "PLY", b"BC1": "Bitcode", b"QNT": "Quantize", b"SGP": "SOGP", b"GSP": "GSP16"} | DISABLED | WRAPPED


def encode(cloud: Cloud, p: P.Params) -> bytes:
    P.validate(p, cloud.kind)
    if P.is_wrapper(p) and not isinstance(p, P.Openzl):
        name = P.name_of(p)
        return wrap.MAGIC[name] + wrap.pack(name, encode(cloud, p.inner), getattr(p, "level", None))
    if isinstance(p, P.LASzip):
        raise CodecError("LASzip is not implemented")
    if type(p) not in ENCODERS:
        raise FeatureDisabled(f"{P.name_of(p)} isn't available")
    return ENCODERS[type(p)](cloud, p)


def sniff(data: bytes) -> str:
    """The format's name, by the first three bytes."""
    if len(data) < 3:
        raise FormatError("data too short")
    magic = bytes(data[:3])
    if magic not in MAGICS:
        raise FormatError(f"unsupported data format {magic!r}")
    return MAGICS[magic]


def decode(data: bytes) -> Cloud:
    name = sniff(data)
    if name in wrap.MAGIC:
        return decode(wrap.unpack(name, data[3:]))
    if name in DISABLED.values():
        raise FeatureDisabled(f"{name} isn't available")
    return DECODERS[bytes(data[:3])](data)


def chain_of(data: bytes) -> list[str]:
    """Names of the nested formats, outermost first."""
    name = sniff(data)
    return [name, *chain_of(wrap.unpack(name, data[3:]))] if name in wrap.MAGIC else [name]
