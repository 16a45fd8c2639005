"""Elf (Li et al., 2023): low bits that the decimal form can restore are erased before the XOR.

After 64 raw bits, ``1`` and the number of significant digits (4 bits; 0 for
a power of ten under one) mark an erased value, ``0`` one as it is.  The XOR
with the last stored value follows: ``00`` same leading zeros and the last
window; ``01`` no change; ``10`` leading zeros (3), length less one (4), bits;
``11`` the same with 6 bits of length.  A value is erased only if restoring
gives its very bits; NaNs are stored as they are.
"""

from __future__ import annotations

import math

from nearloom.operators.codecs.bits import BitReader, BitWriter, decimal, from_bits, leading_zeros, to_bits, trailing_zeros


def _alpha_bits(alpha: int) -> int:
    """Bits that ``alpha`` decimal places need."""
    return math.ceil(alpha * math.log2(10))


def _magnitude(x: float) -> int:
    """The power of ten of the first digit."""
    m, q = decimal(abs(x))
    return len(str(m)) - 1 + q


def _restore(erased: float, digits: int) -> float:
    top = _magnitude(erased)
    if digits == 0:
        return math.copysign(float(f"1e{top + 1}"), erased)
    places = digits - top - 1
    # Round away from zero at so many places, exactly.
    n, d = abs(erased).as_integer_ratio()
    up = -(-n * 10**places // d) if places >= 0 else -(-n // (d * 10**-places))
    return math.copysign(float(f"{up}e{-places}"), erased)


def _erase(value: float) -> tuple[int, int] | None:
    """``(erased bits, digits)`` if that saves something and can be undone."""
    found = decimal(value)
    bits = to_bits(value)
    if found is None or found[0] == 0:
        return None
    top = len(str(abs(found[0]))) - 1 + found[1]
    places = max(0, -found[1])
    digits = places + top + 1
    stated = 0 if abs(found[0]) == 1 and top < 0 else digits
    keep = _alpha_bits(places) + (bits >> 52 & 0x7FF) - 1023
    spare = 52 - keep
    if digits >= 16 or not 4 < spare < 64 or bits & (1 << spare) - 1 == 0:
        return None
    erased = bits >> spare << spare
    back = from_bits(erased)
    if back == 0 or to_bits(_restore(back, stated)) != bits:
        return None
    return erased, stated


class _State:
    def __init__(self) -> None:
        self.last: int | None = None
        self.lead = self.tail = 0


class ElfEncoder(_State):
    def encode(self, value: float, out: BitWriter) -> None:
        if self.last is None:
            self.last = to_bits(value)
            out.put(self.last, 64)
            return
        found = _erase(value)
        bits = to_bits(value) if found is None else found[0]
        out.put(0, 1) if found is None else out.put(0b10000 | found[1], 5)
        change = bits ^ self.last
        lead, tail = min(leading_zeros(change), 7), trailing_zeros(change)
        if not change:
            out.put(0b01, 2)
        elif lead == self.lead and tail >= self.tail:
            out.put(0b00, 2)
            out.put(change >> self.tail, 64 - self.lead - self.tail)
        else:
            width = 64 - lead - tail
            out.put(0b10 | (width > 16), 2)
            out.put(lead, 3)
            out.put(width - 1, 6 if width > 16 else 4)
            out.put(change >> tail, width)
        self.last, self.lead, self.tail = bits, lead, tail


class ElfDecoder(_State):
    def decode(self, bits: BitReader) -> float:
        if self.last is None:
            self.last = bits.get(64)
            return from_bits(self.last)
        digits = bits.get(4) if bits.get(1) else None
        kind = bits.get(2)
        change = 0
        if kind == 0:
            change = bits.get(64 - self.lead - self.tail) << self.tail
        elif kind > 1:
            lead = bits.get(3)
            width = bits.get(6 if kind == 3 else 4) + 1
            change = bits.get(width) << 64 - lead - width
        self.last ^= change
        self.lead, self.tail = min(leading_zeros(change), 7), trailing_zeros(change)
        value = from_bits(self.last)
        return value if digits is None else _restore(value, digits)
