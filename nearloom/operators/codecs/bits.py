"""Bit strings, most significant bit first, and the bits of doubles."""

from __future__ import annotations

import struct


NEGATIVE_ZERO = 1 << 63


class BitWriter:
    """Collects bits; :meth:`take` gives the bytes so far, the last one padded with zeros."""

    def __init__(self) -> None:
        self._bytes = bytearray()
        self._rest = self._width = 0
        self.n_bits = 0

    def put(self, value: int, width: int) -> None:
        self._rest = self._rest << width | value & (1 << width) - 1
        self._width += width
        self.n_bits += width
        if self._width >= 512:
            spare = self._width & 7
            self._bytes += (self._rest >> spare).to_bytes((self._width - spare) // 8, "big")
            self._rest, self._width = self._rest & (1 << spare) - 1, spare

    def take(self) -> tuple[bytes, int]:
        pad = -self._width % 8
        out, n = bytes(self._bytes) + (self._rest << pad).to_bytes((self._width + pad) // 8, "big"), self.n_bits
        self.__init__()
        return out, n


class BitReader:
    def __init__(self, data: bytes, n_bits: int | None = None):
        self._data, self._at = data, 0
        self._end = len(data) * 8 if n_bits is None else n_bits

    def get(self, width: int) -> int:
        if self._at + width > self._end:
            raise EOFError("the bit stream ends here")
        first, last = self._at >> 3, self._at + width + 7 >> 3
        value = int.from_bytes(self._data[first:last], "big") >> (last * 8 - self._at - width)
        self._at += width
        return value & (1 << width) - 1


def to_bits(x: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", x))[0]


def from_bits(b: int) -> float:
    return struct.unpack(">d", struct.pack(">Q", b))[0]


def leading_zeros(b: int) -> int:
    return 64 - b.bit_length()


def trailing_zeros(b: int) -> int:
    return (b & -b).bit_length() - 1 if b else 64


def decimal(x: float) -> tuple[int, int] | None:
    """``(m, q)`` with ``x`` the double nearest to ``m * 10**q`` and as few digits as that allows; None if not finite.

    ``m`` does not end in 0, save that zero is ``(0, 0)``.
    """
    if x != x or x in (float("inf"), float("-inf")):
        return None
    text, _, exponent = repr(x).partition("e")
    whole, _, fraction = text.partition(".")
    m, q = int(whole + fraction), int(exponent or 0) - len(fraction)
    if m == 0:
        return 0, 0
    while m % 10 == 0:
        m, q = m // 10, q + 1
    return m, q


#: Powers of ten that doubles hold exactly: a quotient of two exact numbers is rounded once, as a number that is read.
_EXACT = [10.0**i for i in range(23)]


def from_decimal(m: int, q: int) -> float:
    if -22 <= q <= 0 and -(1 << 53) <= m <= 1 << 53:
        return m / _EXACT[-q]
    return float(f"{m}e{q}")


def decimal_bits(digits: int) -> int:
    """Bits that any number of so many decimal digits fits in."""
    return (10**digits - 1).bit_length()
