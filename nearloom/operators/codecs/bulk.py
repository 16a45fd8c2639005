"""The codecs over arrays: what each of them writes for the values of many blocks, at once.

A block starts with a fresh codec, so the state in which a value is coded
follows from values before it in its block: the last one, the last changed or
finite one, or the last few.  Fields and widths are those of the encoders, bit
for bit.  What arrays do not hold exactly is left to these: single values to
their decimal forms, whole blocks (numbers too large for Camel's whole parts,
or that DeXOR skips) to the encoder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from typing import Any

import numpy as np

from nearloom.operators.codecs import camel, dexor, elf
from nearloom.operators.codecs.bits import NEGATIVE_ZERO, BitWriter, decimal, decimal_bits
from nearloom.operators.codecs.registry import copied, encoder, stated

Tried = Sequence[tuple[str, dict[str, int] | None]]
#: By value the codes that are written one after another and their widths, 0 for none; and by block whether it is left to the encoder.
Fields = tuple[np.ndarray, np.ndarray, np.ndarray]

#: Decimal places that are looked for in arrays; and the bits of ring places of DeXOR, at most.
PLACES, RING = 10, 4
#: The size of a coding that was given up.
GIVEN_UP = 1 << 62

#: Values that are coded one by one at the beginning of :func:`carried`, and those at its end that tell the state.
LED = 64
#: What exceptions of DeXOR leave in its state, and nothing else changes.
_EXCEPTIONS = ("exponent", "length", "small")

_TENS = 10 ** np.arange(19, dtype=np.uint64)
_FLOAT_TENS = 10.0 ** np.arange(23)
_LEAST_POWER = -300
_POWERS = np.array([float(f"1e{i}") for i in range(_LEAST_POWER, 309)])
_ALPHA = np.array([elf._alpha_bits(i) for i in range(512)])
_DIGIT_BITS = np.array([decimal_bits(i) for i in range(dexor.PLACES)])
_FIVES = 5 ** np.arange(5)
# Camel's rests by number of decimals: widths by selector, and past what rest a selector does not do.
_REST = np.array([[*camel.WIDTHS.get(p, ()), 0, 0, 0, 0][:4] for p in range(5)])
_PAST = np.array([[1 << w for w in camel.WIDTHS.get(p, ())][:-1] + [1 << 62] * (4 - max(0, len(camel.WIDTHS.get(p, ())) - 1)) for p in range(5)])
_SELECTOR = np.array([camel.SELECTOR.get(p, 0) for p in range(5)])


def _leading(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(s)
    return 64 - np.bitwise_count(x).astype(np.int64)


def _trailing(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64)


def _right(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return x >> np.minimum(by, 63).astype(np.uint64)


class Rows:
    """The values of blocks that lie one after another, and where each block starts."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values, self.starts = np.ascontiguousarray(values, np.float64), np.asarray(starts, np.int64)
        self.bits = self.values.view(np.uint64)
        self.lengths = np.diff(self.starts, append=len(self.values))
        self.at = np.arange(len(self.values))
        self.block = np.repeat(np.arange(len(self.starts)), self.lengths)
        self.begin = self.starts[self.block]
        self.first = self.at == self.begin
        self.finite = np.isfinite(self.values)

    @cached_property
    def decimals(self) -> tuple[np.ndarray, np.ndarray]:
        """``(m, q)`` of :func:`decimal`, zeros where a value is not finite.

        Of the decimals of at most 15 digits no two are the same double, so one
        that gives a value is its shortest form.
        """
        m, q = np.zeros(len(self.values), np.int64), np.zeros(len(self.values), np.int64)
        left = np.flatnonzero(self.finite & (self.values != 0))
        for places in range(PLACES + 1):
            own = self.values[left]
            with np.errstate(over="ignore"):
                scaled = np.rint(own * _FLOAT_TENS[places])
            hit = (np.abs(scaled) < 1e15) & (scaled / _FLOAT_TENS[places] == own)
            m[left[hit]], q[left[hit]] = scaled[hit].astype(np.int64), -places
            left = left[~hit]
        for i in left.tolist():
            m[i], q[i] = decimal(float(self.values[i]))
        even = np.flatnonzero((m % 10 == 0) & (m != 0))
        while len(even):
            m[even] //= 10
            q[even] += 1
            even = even[m[even] % 10 == 0]
        return m, q

    def before(self, mask: np.ndarray) -> np.ndarray:
        """The last place of ``mask`` before each in its block, -1 if there is none."""
        last = np.maximum.accumulate(np.where(mask, self.at, -1))
        last = np.concatenate([[-1], last[:-1]])
        return np.where(last >= self.begin, last, -1)

    def blocks_with(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.block[mask], minlength=len(self.starts)) > 0


def _previous(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def _fields(*columns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([c.astype(np.uint64) for c, _ in columns], 1), np.stack([w.astype(np.int64) for _, w in columns], 1)


def _gorilla(rows: Rows) -> Fields:
    change = np.where(rows.first, np.uint64(0), rows.bits ^ _previous(rows.bits))
    changed = change != 0
    lead, tail = _leading(change), _trailing(change)
    last = rows.before(changed)
    own_lead, own_tail = np.where(last < 0, 0, lead[last]), np.where(last < 0, 0, tail[last])
    inside = changed & (lead >= own_lead) & (tail >= own_tail)
    stated = np.minimum(lead, 31)
    width = np.where(changed, 64 - stated - tail, 1)
    head = np.where(inside, 0b01, np.where(changed, stated << 6 | width - 1, 1))
    head_width = np.where(rows.first, 0, np.where(inside, 2, np.where(changed, 13, 1)))
    body = np.where(rows.first, rows.bits, _right(change, np.where(inside, own_tail, tail)))
    body_width = np.where(rows.first, 64, np.where(inside, 64 - own_lead - own_tail, np.where(changed, width, 0)))
    return *_fields((head, head_width), (body, body_width)), np.zeros(len(rows.starts), bool)


def _erased(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether Elf erases bits of a value, what is left of it, and the digits that are stated."""
    m, q = rows.decimals
    size = np.abs(m)
    top = np.searchsorted(_TENS, size.astype(np.uint64), side="right") - 1 + q
    places = np.maximum(0, -q)
    digits = places + top + 1
    stated = np.where((size == 1) & (top < 0), 0, digits)
    spare = 52 - (_ALPHA[places] + (rows.bits >> np.uint64(52) & np.uint64(0x7FF)).astype(np.int64) - 1023)
    low = (np.uint64(1) << np.clip(spare, 0, 63).astype(np.uint64)) - np.uint64(1)
    bits = rows.bits & ~low
    back = np.abs(bits.view(np.float64))
    cut = rows.finite & (m != 0) & (digits < 16) & (spare > 4) & (spare < 64) & (rows.bits & low != 0) & (back != 0)
    # Rounded up at its last place, the rest gives the value again if it is past the decimal that is one less there.
    back_top = np.searchsorted(_POWERS, back, side="right") - 1 + _LEAST_POWER
    below = (size - 1) / _FLOAT_TENS[np.minimum(places, 22)]
    power = stated == 0
    plain = (size < 10**15) & (q <= 0) & (places <= 22) & (back >= _POWERS[0]) & (power | (back_top == top) & (back != below))
    for i in np.flatnonzero(cut & ~plain).tolist():
        cut[i] = elf._erase(float(rows.values[i])) is not None
    return cut & (~plain | np.where(power, back_top + 1 == top, back > below)), bits, stated


def _elf(rows: Rows) -> Fields:
    cut, erased, digits = _erased(rows)
    cut = cut & ~rows.first
    bits = np.where(cut, erased, rows.bits)
    change = np.where(rows.first, np.uint64(0), bits ^ _previous(bits))
    lead, tail = np.where(rows.first, 0, np.minimum(_leading(change), 7)), np.where(rows.first, 0, _trailing(change))
    own_lead, own_tail = _previous(lead), _previous(tail)
    same = change == 0
    inside = ~same & (lead == own_lead) & (tail >= own_tail)
    width = np.where(same, 1, 64 - lead - tail)
    large = width > 16
    head = np.where(cut, 0b10000 | digits, 0)
    head = np.where(same, head << 2 | 0b01, np.where(inside, head << 2, ((head << 2 | 0b10 | large) << 3 | lead) << np.where(large, 6, 4) | width - 1))
    head_width = np.where(cut, 5, 1) + np.where(same | inside, 2, np.where(large, 11, 9))
    body = np.where(rows.first, bits, _right(change, np.where(inside, own_tail, tail)))
    body_width = np.where(rows.first, 64, np.where(same, 0, np.where(inside, 64 - own_lead - own_tail, width)))
    return *_fields((head, np.where(rows.first, 0, head_width)), (body, body_width)), np.zeros(len(rows.starts), bool)


def _camel(rows: Rows) -> Fields:
    m, q = rows.decimals
    huge = rows.finite & (np.abs(rows.values) >= 1e15)
    negative = rows.bits == np.uint64(NEGATIVE_ZERO)
    formed = rows.finite & (q >= -4) & ~huge
    places = np.where(formed, np.maximum(1, -q), 1)
    whole, rest = np.divmod(np.where(formed, m, 0) * _TENS.astype(np.int64)[np.where(formed, places + q, 0)], _TENS.astype(np.int64)[places])
    last = rows.before(rows.finite)
    floors = np.floor(np.where(rows.finite & ~huge, rows.values, 0)).astype(np.int64)
    step = whole - np.where(last < 0, 0, floors[last])
    formed &= np.abs(step) < 1 << 16
    large = np.abs(step) >= 8
    near = np.abs(step) <= 1
    step_width = np.where(near, 2, np.where(large, 20, 7))
    code = np.where(near, step + 1, (0b1100 | (step > 0) << 1 | large) << np.where(large, 16, 3) | np.abs(step))
    head, rest = np.divmod(rest, _FIVES[places])
    rest = np.where(negative, camel.NEGATIVE, rest)
    selector = (rest[:, None] >= _PAST[places]).sum(1)
    width = _REST[places, selector]
    code = code << 2 | places - 1
    code = np.where(head > 0, (code << 1 | 1) << places | head, code << 1)
    code = (code << _SELECTOR[places] | selector) << width | rest
    code_width = step_width + 3 + np.where(head > 0, places, 0) + _SELECTOR[places] + width
    raw = rows.first | ~formed
    return *_fields((np.where(raw, camel.ESCAPE, code), np.where(rows.first, 0, np.where(raw, 20, code_width))), (rows.bits, np.where(raw, 64, 0))), rows.blocks_with(huge)


def _near(numbers: list[int], units: list[int], ring: int) -> list[bool]:
    """Which numbers share all but the last places, above their units, with one of the last ``ring`` for which that holds."""
    known, at, out = [0] * ring, 0, []
    for n, unit in zip(numbers, units, strict=True):
        size = abs(n) // unit * unit
        low, high = (1 - unit, unit - 1) if not size else (size, size + unit - 1) if n > 0 else (1 - size - unit, -size)
        out.append(any(low <= k <= high for k in known))
        if out[-1]:
            known[at], at = n, (at + 1) % ring
    return out


def _exceptions(rows: Rows, at: np.ndarray, rho: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of DeXOR's exceptions' exponents, their widths, and whether they fit in these."""
    codes, lengths, fits = [], [], []
    now, state = -1, None
    for block, exponent in zip(rows.block[at].tolist(), (rows.bits[at] >> np.uint64(52) & np.uint64(0x7FF)).tolist(), strict=True):
        if block != now:
            now, state = block, dexor.DeXorEncoder(rho=rho)
        bias, step = (1 << state.length - 1) - 1, exponent - state.exponent
        fits.append(abs(step) <= bias)
        codes.append(step + bias if fits[-1] else (1 << state.length) - 1)
        lengths.append(state.length)
        state.after_exception(exponent)
    return np.array(codes, np.int64), np.array(lengths, np.int64), np.array(fits, bool)


def _dexor(rows: Rows, buffer_bits: int = 0, rho: int = 8, skip_available: int = -1) -> Fields:
    m, q = rows.decimals
    ring, negative = 1 << buffer_bits, rows.bits == np.uint64(NEGATIVE_ZERO)
    coded = rows.finite & (q >= -dexor.OFFSET) & (q < 32 - dexor.OFFSET)
    left = np.zeros(len(rows.starts), bool)
    size = np.abs(m).astype(np.uint64)
    # In units of the least place of a block, any number below 10^15 shares a prefix of zero with any other; else what was coded before decides.
    places = np.where(coded, q - np.minimum.reduceat(np.where(coded, q, 32), rows.starts)[rows.block], 0)
    for i in np.flatnonzero(rows.blocks_with(coded & (size * 10.0**places > 9e14))).tolist():
        own = np.flatnonzero(coded[rows.starts[i] :][: rows.lengths[i]]) + rows.starts[i]
        tens = [10**p for p in places[own].tolist()]
        coded[own] = _near([n * ten for n, ten in zip(m[own].tolist(), tens, strict=True)], [ten * 10 ** (dexor.PLACES - 1) for ten in tens], ring)
    if skip_available >= 0 and not buffer_bits:
        left |= rows.blocks_with(~coded)
        coded &= ~left[rows.block]
    own = np.flatnonzero(coded)
    nth = np.arange(len(own)) - np.searchsorted(own, rows.begin[own])
    m, q, size, minus = m[own], q[own], size[own], m[own] < 0
    lags = np.arange(1, ring + 1)[:, None]
    source = np.maximum(np.arange(len(own)) - lags, 0)
    # What was coded, in units of a value's last place: by way of those of the block's least, if arrays hold all numbers in these.
    places = places[own]
    scale = _TENS[np.clip(places, 0, 18)]
    larger = bool((size > np.uint64(10**18) // scale).any() or (places > 18).any())
    if larger:  # with more zeros than there is room for, it is larger than any value until that many places are left out
        known = np.where(nth >= lags, size[source], np.uint64(0))
        apart = np.where(known == 0, 0, q[source] - q)
        room = (18 - np.searchsorted(_TENS, size, side="right"))[source]
        known = np.where(apart < 0, known // _TENS[np.clip(-apart, 0, 18)], known * _TENS[np.clip(apart, 0, room)])
        zeros = np.maximum(apart - room, 0)
    else:
        known = np.where(nth >= lags, (size * scale)[source], np.uint64(0)) // scale
    known_minus, slots = minus[source], (nth - lags) % ring
    rest, prefix = np.arange(len(own)), size
    delta, slot, zero = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
    for d in range(dexor.PLACES):
        if d:
            prefix, known = prefix // np.uint64(10), np.where(zeros > 0, known, known // np.uint64(10)) if larger else known // np.uint64(10)
            zeros = np.maximum(zeros - 1, 0) if larger else None
        same = (known == prefix) & ((prefix == 0) | (known_minus == minus[rest]))
        shared = np.where(same & (zeros == 0) if larger else same, slots, ring).min(0)
        hit = shared < ring
        delta[rest[hit]], slot[rest[hit]], zero[rest[hit]] = d, shared[hit], prefix[hit] == 0
        rest, prefix = rest[~hit], prefix[~hit]
        known, known_minus, slots = known[:, ~hit], known_minus[:, ~hit], slots[:, ~hit]
        zeros = zeros[:, ~hit] if larger else None
        if not len(rest):
            break
    own_q, own_delta = np.where(nth == 0, 0, _previous(q)), np.where(nth == 0, 0, _previous(delta))
    place = q == own_q
    both = place & (delta == own_delta)
    width = _DIGIT_BITS[delta]
    positive = (m > 0) | negative[own]
    codes, widths = np.zeros((len(rows.at), 2), np.uint64), np.zeros((len(rows.at), 2), np.int64)
    codes[own, 0] = np.where(both, 0b10 << buffer_bits | slot, np.where(place, (0b01 << buffer_bits | slot) << 4 | delta, (slot << 5 | q + dexor.OFFSET) << 4 | delta))
    widths[own, 0] = buffer_bits + np.where(both, 2, np.where(place, 6, 11))
    codes[own, 1] = (size % _TENS[delta]).astype(np.int64) | np.where(zero & positive, np.int64(1) << width, 0)
    widths[own, 1] = width + zero
    other = np.flatnonzero(~coded & ~left[rows.block])
    exponents, lengths, fits = _exceptions(rows, other, rho)
    raw = rows.bits[other]
    codes[other, 0], widths[other, 0] = np.int64(0b11) << lengths | exponents, 2 + lengths
    codes[other, 1] = np.where(fits, raw >> np.uint64(63) << np.uint64(52) | raw & np.uint64((1 << 52) - 1), raw)
    widths[other, 1] = np.where(fits, 53, 64)
    return codes, widths, left


_BY_NAME: dict[str, Callable[..., Fields]] = {"Gorilla": _gorilla, "Elf": _elf, "Camel": _camel, "DeXOR": _dexor}


def _written(rows: Rows, codec: str, config: dict[str, int] | None) -> Fields:
    if (config or {}).get("buffer_bits", 0) > RING:
        none = np.zeros((len(rows.values), 1), np.int64)
        return none.astype(np.uint64), none, np.ones(len(rows.starts), bool)
    return _BY_NAME[codec](rows, **(config or {}))


def _alone(values: list[float], codec: str, config: dict[str, int] | None, most: int = GIVEN_UP) -> tuple[bytes, int]:
    """What the encoder makes of a block, unless that takes more than ``most`` bits."""
    state, out = encoder(codec, config), BitWriter()
    for v in values:
        state.encode(v, out)
        if out.n_bits > most:
            return b"", GIVEN_UP
    return out.take()


def _packed(codes: np.ndarray, widths: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Blocks of so many bits, the last byte of each padded with zeros."""
    each = np.unpackbits(codes.reshape(-1, 1).astype(">u8").view(np.uint8), axis=1)
    bits = each[np.arange(64) >= 64 - widths.reshape(-1, 1)]
    ends = np.cumsum(sizes)
    return [np.packbits(bits[i:j]).tobytes() for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def sizes(values: np.ndarray, starts: np.ndarray, tried: Tried) -> np.ndarray:
    """The bits of every block by every codec alone, a row per block."""
    rows = Rows(values, starts)
    out = np.zeros((len(rows.starts), len(tried)), np.int64)
    for at, (codec, config) in enumerate(tried):
        _, widths, left = _written(rows, codec, config)
        out[:, at] = np.add.reduceat(widths.sum(1), rows.starts)
        for i in np.flatnonzero(left).tolist():
            out[i, at] = _alone(_values(rows, i), codec, config)[1]
    return out


def smallest(values: np.ndarray, starts: np.ndarray, tried: Tried) -> list[tuple[int, bytes, int]]:
    """``(place in tried, data, bits)`` of the smallest coding of every block; the first of equally small ones."""
    rows = Rows(values, starts)
    written = [_written(rows, *one) for one in tried]
    bits = np.stack([np.where(left, GIVEN_UP, np.add.reduceat(widths.sum(1), rows.starts)) for _, widths, left in written], 1)
    alone = {}
    for at, (_, _, left) in enumerate(written):
        for i in np.flatnonzero(left).tolist():
            alone[i, at], bits[i, at] = _alone(_values(rows, i), *tried[at], int(bits[i].min()))
    best = bits.argmin(1)
    data: list[bytes] = [b""] * len(best)
    for at, (codes, widths, left) in enumerate(written):
        own = (best == at) & ~left
        taken = own[rows.block]
        for i, packed in zip(np.flatnonzero(own).tolist(), _packed(codes[taken], widths[taken], bits[own, at]), strict=True):
            data[i] = packed
    return [(at, alone.get((i, at), data[i]), n) for i, (at, n) in enumerate(zip(best.tolist(), bits.min(1).tolist(), strict=True))]


def _values(rows: Rows, block: int) -> list[float]:
    return rows.values[rows.starts[block] :][: rows.lengths[block]].tolist()


def carried(coder: Any, values: np.ndarray, codec: str, config: dict[str, int] | None = None) -> tuple[Any, int]:
    """The encoder that comes after ``values`` to ``coder``, and the bits that these take.

    After a few values a fresh encoder is in the state of one that has come a
    long way, so the rest is sized in arrays; and the last few values tell the
    state at the end.  Where either is not certain all values are coded.
    """
    if len(values) >= 4 * LED:
        head, tail = values[:LED].tolist(), values[-LED:]
        first, fresh, last = BitWriter(), encoder(codec, config), encoder(codec, config)
        led, spare = copied(coder), BitWriter()
        for v in head:
            led.encode(v, first)
            fresh.encode(v, spare)
        for v in tail.tolist():
            last.encode(v, spare)
        for name in _EXCEPTIONS if codec == "DeXOR" else ():
            for other in (fresh, last):
                setattr(other, name, getattr(led, name))
        if stated(led) == stated(fresh) and _told(tail, codec):
            _, widths, left = _written(Rows(values, np.zeros(1, np.int64)), codec, config)
            # An exception of DeXOR has 53 bits or more behind its head, and no other value has.
            if not left.any() and not (codec == "DeXOR" and (widths[:, 1] > 52).any()):
                return last, first.n_bits + int(widths[LED:].sum())
    bits = 0
    for start in range(0, len(values), 4_096):
        out = BitWriter()
        for v in values[start : start + 4_096].tolist():
            coder.encode(v, out)
        bits += out.n_bits
    return coder, bits


def _told(tail: np.ndarray, codec: str) -> bool:
    """Whether the state after the LED values of ``tail`` is the same whatever came before them."""
    if codec == "Gorilla":  # the window is that of the last change
        return bool((np.diff(tail.view(np.uint64)) != 0).any())
    if codec == "Camel":  # the whole part is that of the last finite value
        return bool(np.isfinite(tail).any())
    return codec in ("Elf", "DeXOR")  # the last two values; the last values of the ring and those before, if none is an exception
