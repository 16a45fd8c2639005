"""Packing tokenised documents into sequences by vector best-fit.

Each open sequence has residual capacities: tokens, documents and attention
cost (the sum of squared piece lengths).  Pieces, the largest first, go to the
sequence that fits best among those where every capacity suffices: the one
with the smallest weighted norm of what would be left, or the largest weighted
dot product of demand and residual.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearloom.llm.runtime import ship, slices, stored

#: Pieces that one task packs together; what its last sequences leave free, later rounds fill with other groups' pieces.
GROUP = 4_000
#: A sequence that is less full than this is taken apart for the next round.
OPEN = 0.95
#: Encodings that a Python worker keeps from batch to batch, and the longest chunk kept.
KEPT, LONG = 400_000, 64


TOKENS = 1024


class Capacity(NamedTuple):
    """What a sequence can hold at most."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS


class Ids:
    """Ids by a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    A text is cut before each space that a letter, digit or mark follows: no
    pre-token of this tokenizer goes past such a place.  Chunks are encoded
    once and kept, by the merge ranks of the same vocabulary; texts that hold
    a special token's string are encoded whole by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str | None, special: bool = True) -> bytes:
        """The ids of ``text``; without ``special`` the special tokens' strings are plain text."""
        if not text:
            return b""
        if special and any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > KEPT:
            self.known.clear()
        first, *rest = text.split(" ")
        if _SPACES.search(text):
            merged = [first]
            for w in rest:
                if not w or w[0].isspace():
                    merged[-1] += " " + w
                else:
                    merged.append(w)
            first, *rest = merged
        out = list(map(self.known.get, rest))
        if None in out:
            out = [(self.known.get(w) or self._spaced(w)) if got is None else got for w, got in zip(rest, out, strict=True)]
        return b"".join([self._chunk(first), *out] if first else out)

    def _chunk(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _spaced(self, word: str) -> bytes:
        ids = self._chunk(" " + word)
        if len(word) <= LONG:
            self.known[word] = ids
        return ids


# A space that no word follows: what comes after it belongs to it.
_SPACES = re.compile(r" (?:\s|\Z)")

# The pre-tokens of the byte-level tokenizer: a fixed pattern of its format.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Ids:
    return Ids(path)


def tokenised(docs: DataFrame, path: str, end_id: int, tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, its ids followed by ``end_id``: ``(doc_id, piece, start, length, ids_crc32)``.

    A document of more than ``tokens`` ids is cut so that all its pieces but
    the first are full.  Null texts are empty: one piece, of ``end_id`` alone.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                ids = memoryview(ids_of(text) + end)
                total = len(ids) // 4
                at, k = 0, 0
                while at < total:
                    size = (total - 1) % tokens + 1 if k == 0 else tokens
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            doc = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each piece of ``sizes`` tokens.

    Demands are (tokens, 1 document, tokens squared), scaled by ``capacity``.
    ``rule`` is ``norm`` (smallest weighted norm of the residual that would
    be left) or ``dot`` (largest weighted dot product of demand and residual).
    A piece over a capacity by itself gets a bin of its own only if its
    tokens fit; else it raises.
    """
    limit = np.array(capacity, float)
    demand = np.stack([sizes, np.ones(len(sizes)), sizes.astype(float) ** 2], axis=1) / limit
    if len(sizes) and demand.max() > 1:
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    w = np.array(weights)
    left = np.ones((64, 3))
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    alive = np.zeros(64, np.int64)  # the bins' numbers: full bins leave the table
    used = np.zeros(64, np.int64)
    count = total = 0
    smallest = demand[:, 0].min() if len(sizes) else 0
    for i in np.argsort(-sizes, kind="stable"):
        d = demand[i]
        if sizes[i] >= capacity.tokens:  # full by itself
            bins[i], total = total, total + 1
            continue
        rest = left[:count] - d
        fit = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fit):
            score = ((rest[fit] ** 2) @ w) if rule == "norm" else -(left[fit] @ (w * d))
            at = fit[score.argmin()]
        else:
            if count == len(left):
                left, alive, used = np.concatenate([left, np.ones_like(left)]), np.concatenate([alive, np.zeros_like(alive)]), np.concatenate([used, np.zeros_like(used)])
            at, count, total = count, count + 1, total + 1
            left[at], alive[at], used[at] = 1, total - 1, 0
        bins[i], offset[i] = alive[at], used[at]
        left[at] -= d
        used[at] += sizes[i]
        if left[at].min() < 1e-12 or left[at, 0] < smallest - 1e-12:  # nothing more fits: the last bin takes its place
            count -= 1
            left[at], alive[at], used[at] = left[count], alive[count], used[count]
    return bins, offset


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: Capacity | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All documents in sequences: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row per piece.

    See :func:`tokenised` for the pieces.  Without a ``capacity`` sequences
    hold TOKENS tokens of any number of documents: nothing else may cost a
    sequence.  Pieces are dealt evenly to groups of about ``GROUP``, whatever the documents' ids, and each group is packed by
    itself; then the sequences that are less than OPEN full are taken apart,
    and their pieces packed again in fewer groups, until one group is left or
    a round saves nothing.  Null ids and repeated rows are packed like any other; an
    empty table gives no rows; only the two named columns are read.
    """
    tokens = TOKENS if capacity is None else capacity.tokens
    parts = stored(tokenised(docs, path, end_id, tokens, id_col, text_col), "pieces")
    count = parts.count()
    limit = Capacity() if capacity is None else capacity
    left, done, round_, before = parts, [], 0, None
    while True:
        groups = max(1, -(-count // GROUP))
        packed = _grouped(left, groups, round_, limit, weights, rule)
        if groups == 1:
            done.append(packed.drop("filled"))
            break
        packed = stored(packed, "packed")
        open_ = packed.where(F.col("filled") < OPEN * limit.tokens)
        again, bins, tokens_again = open_.agg(F.count("*"), F.count_distinct("sequence_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
        fewest = -(-tokens_again // limit.tokens)
        if not again or bins <= fewest or (before is not None and bins >= before):
            done.append(packed.drop("filled"))  # nothing is left to gain, or the last round gained nothing
            break
        done.append(packed.where(F.col("filled") >= OPEN * limit.tokens).drop("filled"))
        left, count, round_, before = open_.select(*parts.columns), again, round_ + 1, bins
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _grouped(parts: DataFrame, groups: int, round_: int, capacity: Capacity, weights: tuple[float, float, float], rule: str) -> DataFrame:
    """``parts`` packed in ``groups``, with ``sequence_id``, ``offset`` and the tokens that the sequence has in all, ``filled``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        sizes = table.column("length").to_numpy()
        bins, offset = best_fit(sizes, capacity, weights, rule)
        filled = np.bincount(bins, sizes).astype(np.int64)[bins]
        names = bins + (round_ << 56) + (group << 24)  # at most GROUP-like numbers of bins in a group
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(names)).append_column("offset", pa.array(offset)).append_column("filled", pa.array(filled))

    # A digest of the whole row: repeated rows of one document must not fall into one group by its id.
    group = F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
    return parts.withColumn("group", group).groupBy("group").applyInArrow(run, schema)
