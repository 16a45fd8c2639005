"""A SentencePiece model file as a table of scored pieces, and how a text is made ready for it.

The file is the public protocol-buffer format: field 1 repeats pieces (1 text,
2 score, 3 type), field 3 is the normaliser (1 name, 3 dummy prefix, 4 extra
white space removed).  Only models with the identity normaliser are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

SPACE = "▁"
# Types of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        value |= (x & 127) << shift
        i, shift = i + 1, shift + 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Pieces(NamedTuple):
    texts: tuple[str, ...]
    scores: dict[str, float]  # of the pieces that a segmentation may use
    ids: dict[str, int]
    byte_ids: dict[int, int]  # empty without byte fallback
    unknown_id: int
    unknown_score: float
    longest: int
    dummy_prefix: bool
    hidden: frozenset[int]  # ids that decode to nothing


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        fields = list(_fields(f.read()))
    texts, scores, ids, byte_ids, hidden, unknown = [], {}, {}, {}, set(), 0
    for i, piece in enumerate(v for k, v in fields if k == 1):
        of = dict(_fields(piece))
        text, kind = of[1].decode(), of.get(3, NORMAL)
        texts.append(text)
        if kind == BYTE:
            byte_ids[int(text[3:-1], 16)] = i
        elif kind == UNKNOWN:
            unknown = i
        elif kind in (NORMAL, USER):
            scores[text], ids[text] = struct.unpack("<f", of.get(2, b"\0\0\0\0"))[0], i
        else:
            hidden.add(i)
    norm = dict(_fields(next(v for k, v in fields if k == 3)))
    if norm.get(1, b"identity") != b"identity" or norm.get(2) or norm.get(4, 1):
        raise ValueError("only models with the identity normaliser that keep white space are read")
    if any(SPACE in t.lstrip(SPACE) for t in scores):
        raise ValueError("a piece goes past a space: texts of this model can't be cut before spaces")
    return Pieces(tuple(texts), scores, ids, byte_ids, unknown, min(scores.values()) - UNKNOWN_PENALTY, max(map(len, scores)), bool(norm.get(3, 1)), frozenset(hidden))


_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def pre_tokens(text: str | None, model: Pieces) -> list[str]:
    """The text made ready and cut before each run of spaces: no piece goes past such a place."""
    if not text:
        return []
    if model.dummy_prefix:
        text = " " + text
    first, *rest = text.split(" ")
    if "" in rest:  # spaces in a row, or at the end
        return _CUT.split(text.replace(" ", SPACE))
    return ([first] if first else []) + [SPACE + w for w in rest]
