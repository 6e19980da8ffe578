"""Typed errors of the codecs."""

from __future__ import annotations


class CodecError(ValueError):
    """A payload or a parameter that can't be handled."""


class UnsupportedKind(CodecError):
    """A codec chain that can't hold the kind of records it is given."""

    def __init__(self, kind: str, colour: str, chain: list[str]):
        super().__init__(f"unsupported spatial kind {kind} ({colour}) for codec chain {' -> '.join(chain)}")
        self.kind, self.colour, self.chain = kind, colour, chain


class FeatureDisabled(CodecError):
    """A format whose library isn't available here."""


class FormatError(CodecError):
    """Bytes that aren't what they claim to be."""
