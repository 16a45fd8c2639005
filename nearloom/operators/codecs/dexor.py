"""DeXOR: a value as the decimal digits that it does not share with the one before.

``q`` is the place of a value's last decimal digit, ``delta`` the number of
places from there to the prefix that it shares with the last coded value.
``10`` keeps both, ``01`` keeps q, ``00`` states q (5 bits, plus 20); delta
takes 4 bits, a prefix of zero a sign bit (1: positive, or negative zero), and the digits past
the prefix the bits that ``delta`` digits need.  ``11`` is an exception:
an exponent difference in EL bits, sign and mantissa, or all ones and 64 raw
bits; EL grows with misses and shrinks after ``rho`` small differences.

All of it is exact decimal arithmetic on shortest forms, so a value is either
coded to its very bits or an exception.  With ``buffer_bits`` the prefix is
the best of the last 2**buffer_bits coded values, named by its place; with
``skip_available`` all values after so many exceptions in a row are exceptions
without a mark.
"""

from __future__ import annotations

from nearloom.operators.codecs.bits import NEGATIVE_ZERO, BitReader, BitWriter, decimal, decimal_bits, from_bits, from_decimal, to_bits

OFFSET, PLACES, MOST_LENGTH = 20, 16, 10


def _cut(m: int, q: int, place: int) -> int:
    """``m * 10**q`` in units of ``10**place``, cut towards zero."""
    if q >= place:
        return m * 10 ** (q - place)
    return abs(m) // 10 ** (place - q) * (1 if m >= 0 else -1)


class _State:
    def __init__(self, buffer_bits: int = 0, rho: int = 8, skip_available: int = -1):
        self.buffer_bits, self.rho, self.skip_available = buffer_bits, rho, skip_available
        self.known = [(0, 0)] * (1 << buffer_bits)
        self.place = self.q = self.delta = 0
        self.exponent, self.length, self.small = 1023, 1, 0
        self.misses, self.skip = 0, False

    def remember(self, m: int, q: int) -> None:
        self.known[self.place] = m, q
        self.place = (self.place + 1) % len(self.known)
        self.misses = 0

    def missed(self) -> None:
        self.misses += 1
        self.skip = self.buffer_bits == 0 and 0 <= self.skip_available <= self.misses

    def after_exception(self, exponent: int) -> None:
        """Adapt EL to the difference just coded."""
        step = exponent - self.exponent
        if abs(step) <= (1 << self.length - 1) - 1:
            if self.length > 1:
                self.small = self.small + 1 if abs(step) <= (1 << self.length - 2) - 1 else 0
                if self.small == self.rho:
                    self.length, self.small = self.length - 1, 0
        else:
            self.small, self.length = 0, min(MOST_LENGTH, self.length + 1)
        self.exponent = exponent


class DeXorEncoder(_State):
    def encode(self, value: float, out: BitWriter) -> None:
        form = None if self.skip else self._form(value)
        if form is None:
            if not self.skip:
                out.put(0b11, 2)
                self.missed()
            self._exception(to_bits(value), out)
            return
        m, q, delta, at, prefix = form
        if (q, delta) == (self.q, self.delta):
            out.put(0b10 << self.buffer_bits | at, 2 + self.buffer_bits)
        elif q == self.q:
            out.put((0b01 << self.buffer_bits | at) << 4 | delta, 6 + self.buffer_bits)
        else:
            out.put((at << 5 | q + OFFSET) << 4 | delta, 11 + self.buffer_bits)
        if prefix == 0:
            out.put(m > 0 or m == 0 and to_bits(value) == NEGATIVE_ZERO, 1)
        out.put(abs(m - prefix * 10**delta), decimal_bits(delta))
        self.q, self.delta = q, delta
        self.remember(m, q)

    def _form(self, value: float) -> tuple[int, int, int, int, int] | None:
        found = decimal(value)
        if found is None or not -OFFSET <= found[1] < 32 - OFFSET:
            return None
        m, q = found
        # In units of the value's last place; a digit less of all of them at each step.
        prefix, known = m, [k if at == q else _cut(k, at, q) for k, at in self.known]
        for delta in range(PLACES):
            if prefix in known:
                return m, q, delta, known.index(prefix), prefix
            prefix = prefix // 10 if prefix >= 0 else -(-prefix // 10)
            known = [k // 10 if k >= 0 else -(-k // 10) for k in known]
        return None

    def _exception(self, bits: int, out: BitWriter) -> None:
        exponent = bits >> 52 & 0x7FF
        bias = (1 << self.length - 1) - 1
        step = exponent - self.exponent
        if abs(step) <= bias:
            out.put(step + bias, self.length)
            out.put(bits >> 63, 1)
            out.put(bits, 52)
        else:
            out.put((1 << self.length) - 1, self.length)
            out.put(bits, 64)
        self.after_exception(exponent)


class DeXorDecoder(_State):
    def decode(self, bits: BitReader) -> float:
        kind = 0b11 if self.skip else bits.get(2)
        if kind == 0b11:
            if not self.skip:
                self.missed()
            return self._exception(bits)
        at = bits.get(self.buffer_bits)
        if kind == 0b00:
            self.q = bits.get(5) - OFFSET
        if kind != 0b10:
            self.delta = bits.get(4)
        prefix = _cut(*self.known[at], self.q + self.delta)
        positive = bits.get(1) if prefix == 0 else prefix > 0
        rest = bits.get(decimal_bits(self.delta))
        m = prefix * 10**self.delta + (rest if positive else -rest)
        self.remember(m, self.q)
        return -0.0 if m == 0 and positive and prefix == 0 else from_decimal(m, self.q)

    def _exception(self, bits: BitReader) -> float:
        code = bits.get(self.length)
        if code == (1 << self.length) - 1:
            raw = bits.get(64)
        else:
            exponent = code - ((1 << self.length - 1) - 1) + self.exponent
            raw = bits.get(1) << 63 | exponent << 52 | bits.get(52)
        self.after_exception(raw >> 52 & 0x7FF)
        return from_bits(raw)
