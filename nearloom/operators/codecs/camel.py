"""Camel: whole parts by difference, and one to four decimals as binary head and decimal rest.

After 64 raw bits, the difference of floors is 2 bits for -1, 0 and 1, else
``11``, a sign bit (1: not negative), a size bit and 3 or 16 bits.  Then the
number of decimals less one (2 bits).  The decimals as a whole number are
``head * 5**l + rest``: a flag says whether there is a head (``l`` bits), and
the rest takes 3 bits (l = 1), 3 or 5 after a selector bit (2), or 1/3/5/7
and 4/6/8/10 after two (3 and 4).

A value with more decimals, a larger jump or no decimal form takes the
otherwise unused code "difference of 16-bit zero" and 64 raw bits.  Negative
zero is coded as zero is, with a rest that no decimal has, so it is as long.
"""

from __future__ import annotations

import math

from nearloom.operators.codecs.bits import NEGATIVE_ZERO, BitReader, BitWriter, decimal, from_bits, from_decimal, to_bits

# Widths of the rest by number of decimals, chosen by a selector of 0, 1 or 2 bits.
WIDTHS = {1: (3,), 2: (3, 5), 3: (1, 3, 5, 7), 4: (4, 6, 8, 10)}
SELECTOR = {1: 0, 2: 1, 3: 2, 4: 2}
ESCAPE = 0b11_1_1 << 16
#: The rest of negative zero: of one decimal, rests are below 5.
NEGATIVE = 7


class _State:
    def __init__(self) -> None:
        self.first = True
        self.whole = 0

    def keep(self, value: float) -> None:
        if math.isfinite(value):
            self.whole = math.floor(value)


def _parts(value: float) -> tuple[int, int, int] | None:
    """``(floor, decimals, their number)`` if they give the value's very bits."""
    if to_bits(value) == NEGATIVE_ZERO:
        return 0, NEGATIVE, 1
    found = decimal(value)
    if found is None or found[1] < -4:
        return None
    m, q = found
    places = max(1, -q)
    scaled = m * 10 ** (places + q)
    whole, rest = divmod(scaled, 10**places)
    return (whole, rest, places) if to_bits(from_decimal(scaled, -places)) == to_bits(value) else None


class CamelEncoder(_State):
    def encode(self, value: float, out: BitWriter) -> None:
        parts = None if self.first else _parts(value)
        if self.first:
            out.put(to_bits(value), 64)
            self.first = False
        elif parts is None or abs(parts[0] - self.whole) >= 1 << 16:
            out.put(ESCAPE, 20)
            out.put(to_bits(value), 64)
        else:
            whole, rest, places = parts
            step = whole - self.whole
            if -1 <= step <= 1:
                out.put(step + 1, 2)
            else:
                large = abs(step) >= 8
                out.put(0b1100 | (step > 0) << 1 | large, 4)
                out.put(abs(step), 16 if large else 3)
            head, rest = divmod(rest, 5**places) if rest != NEGATIVE or to_bits(value) != NEGATIVE_ZERO else (0, rest)
            out.put(places - 1, 2)
            out.put(head > 0, 1)
            if head:
                out.put(head, places)
            code = next(i for i, w in enumerate(WIDTHS[places]) if rest < 1 << w)
            out.put(code, SELECTOR[places])
            out.put(rest, WIDTHS[places][code])
        self.keep(value)


class CamelDecoder(_State):
    def decode(self, bits: BitReader) -> float:
        value = self._next(bits)
        self.keep(value)
        return value

    def _next(self, bits: BitReader) -> float:
        if self.first:
            self.first = False
            return from_bits(bits.get(64))
        step = bits.get(2) - 1
        if step == 2:
            sign = 1 if bits.get(1) else -1
            large = bits.get(1)
            size = bits.get(16 if large else 3)
            if large and size == 0:
                return from_bits(bits.get(64))
            step = sign * size
        places = bits.get(2) + 1
        head = bits.get(places) if bits.get(1) else 0
        rest = bits.get(WIDTHS[places][bits.get(SELECTOR[places])])
        if places == 1 and rest == NEGATIVE:
            return -0.0
        return from_decimal((self.whole + step) * 10**places + head * 5**places + rest, -places)
