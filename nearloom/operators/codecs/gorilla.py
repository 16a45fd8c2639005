"""Gorilla (Pelkonen et al., 2015): the changed bits of a value against the one before.

After 64 raw bits, a value is ``1`` if its bits repeat; else ``0`` and either
``1`` and the bits inside the last change's window, or ``0``, leading zeros
(5 bits, at most 31), length less one (6) and those bits.  Bits are compared,
so signed zeros and NaNs come back as they were.
"""

from __future__ import annotations

from nearloom.operators.codecs.bits import BitReader, BitWriter, from_bits, leading_zeros, to_bits, trailing_zeros


class _State:
    def __init__(self) -> None:
        self.last: int | None = None
        self.lead = self.tail = 0


class GorillaEncoder(_State):
    def encode(self, value: float, out: BitWriter) -> None:
        bits = to_bits(value)
        if self.last is None:
            out.put(bits, 64)
        elif bits == self.last:
            out.put(1, 1)
        else:
            change = bits ^ self.last
            lead, tail = leading_zeros(change), trailing_zeros(change)
            if lead >= self.lead and tail >= self.tail:
                out.put(0b01, 2)
                out.put(change >> self.tail, 64 - self.lead - self.tail)
            else:
                width = 64 - min(lead, 31) - tail
                out.put(0b00, 2)
                out.put(min(lead, 31), 5)
                out.put(width - 1, 6)
                out.put(change >> tail, width)
            self.lead, self.tail = lead, tail
        self.last = bits


class GorillaDecoder(_State):
    def decode(self, bits: BitReader) -> float:
        if self.last is None:
            self.last = bits.get(64)
        elif not bits.get(1):
            if bits.get(1):
                change = bits.get(64 - self.lead - self.tail) << self.tail
            else:
                lead = bits.get(5)
                width = bits.get(6) + 1
                change = bits.get(width) << 64 - lead - width
            self.lead, self.tail = leading_zeros(change), trailing_zeros(change)
            self.last ^= change
        return from_bits(self.last)
