"""A cursor over bytes that never reads past the end."""

from __future__ import annotations

import struct

from ..errors import FormatError


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = memoryview(data), at

    def take(self, n: int) -> memoryview:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(f"wanted {n} bytes at {self.at}, {len(self.data) - self.at} are left")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def magic(self, wanted: bytes) -> None:
        if bytes(self.take(len(wanted))) != wanted:
            raise FormatError(f"not {wanted.decode()}")
