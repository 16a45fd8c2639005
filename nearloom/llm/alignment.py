"""Alignment of two tokenizers' tokens over the same bytes.

Each byte of a text gets a label: no token ends there, one of A's does, one of
B's, or both.  A regular expression reads the labels and cuts spans that end
at a both-label; what a span's labels count are its tokens of A and of B, a
group.  Within a group each label but "none" closes one overlap of a token
of A and a token of B, a link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.packing import KEPT, LONG, Ids, _byte_letters
from nearloom.llm.runtime import ship, slices, stored

#: Id pairs whose counts may be sent to every task: those of the most documents.  Rarer ones are joined.
SENT_PAIRS = 2_000_000
#: Room for ids of B in a pair's number: ``a * PAIR + b``.
PAIR = 1 << 20
#: Characters of text that a Python worker turns into tokens before it hands them on, whatever the number of rows.
TEXT_AT_ONCE = 4_000_000

# Labels of a byte: no token ends there, one of A, one of B, both.
NONE, A_END, B_END, BOTH = b"-", b"a", b"b", b"="
_LETTER = np.frombuffer(NONE + A_END + B_END + BOTH, np.uint8)
_SPAN = re.compile(b"[^=]*=")
# A piece that goes on past a space.
_PAST = re.compile("[^\u2581]\u2581")


class PieceIds:
    """Ids of whole texts by a piece model, as 32-bit numbers; words are encoded once and kept.

    No piece of such a model goes on past a space, so a text may be cut before
    each; where spaces follow each other, begin or end a text, or stand in it
    as U+2581, it is encoded whole, and so are all texts of a model with other
    pieces.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.whole = re.compile("(?s:.)" if any(_PAST.search(p) for p in pieces) else "\u2581|  |\\A | \\Z")
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        if self.whole.search(text):
            return np.array(self.model.encode(text, out_type=int, num_threads=1), np.int64)
        if len(self.known) > KEPT:
            self.known.clear()
        words = text.split(" ")
        out = list(map(self.known.get, words))
        if None in out:
            out = [(self.known.get(w) or self._word(w)) if got is None else got for w, got in zip(words, out, strict=True)]
        return np.frombuffer(b"".join(out), np.int32).astype(np.int64)

    def _word(self, word: str) -> bytes:
        ids = np.array(self.model.encode(word, out_type=int, num_threads=1), np.int32).tobytes()
        if len(word) <= LONG:
            self.known[word] = ids
        return ids


class Sides(NamedTuple):
    """The two tokenizers and, per id, a token's bytes and their number."""

    a: Ids
    b: PieceIds
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_size: np.ndarray
    b_size: np.ndarray
    decimal: dict[str, np.ndarray]  # each id as text, by what follows it


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> Sides:
    a, pieces = Ids(a_path), PieceIds(b_path)
    b = pieces.model
    byte_of = {c: x for x, c in _byte_letters().items()}
    vocabulary = a.whole.get_vocab(with_added_tokens=False)
    a_bytes = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        a_bytes[i] = bytes(byte_of[c] for c in token)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    size = lambda said: np.array([len(x) for x in said], np.int64)
    decimal = {after: np.array([f"{i}{after}" for i in range(max(len(a_bytes), len(b_bytes)))], object) for after in ",|;"}
    return Sides(a, pieces, a_bytes, b_bytes, size(a_bytes), size(b_bytes), decimal)


def tokens(text: str | None, both: Sides) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of A and B, or none if either's bytes are not those of a space and ``text``, or there is no text."""
    if not text:
        return None
    a = np.frombuffer(both.a(" " + text, special=False), "<u4").astype(np.int64)
    b = both.b(text)
    said = b" " + text.encode()
    if any(b"".join(map(of.__getitem__, ids.tolist())) != said for of, ids in ((both.b_bytes, b), (both.a_bytes, a))):
        return None
    return a, b


def labels(a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The label string of a text from the byte offsets where its tokens end."""
    codes = np.zeros(a_ends[-1], np.uint8)
    codes[a_ends - 1] = 1
    codes[b_ends - 1] += 2
    return _LETTER[codes].tobytes()


def groups_of(labelled: bytes) -> np.ndarray:
    """Per group: the byte where it ends, its tokens of A and of B."""
    spans = _SPAN.findall(labelled)
    kinds = {span: i for i, span in enumerate(set(spans))}  # few: what they count is counted once
    shape = np.array([(len(s), s.count(A_END) + s.count(BOTH), s.count(B_END) + s.count(BOTH)) for s in kinds], np.int64).reshape(-1, 3)
    found = shape[np.fromiter(map(kinds.__getitem__, spans), np.int64, len(spans))]
    found[:, 0] = np.cumsum(found[:, 0])
    return found


def links_of(labelled: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs ``a * PAIR + b`` of all overlapping occurrences, in order."""
    code = np.frombuffer(labelled, np.uint8)
    code = code[code != NONE[0]]
    a_end, b_end = code != B_END[0], code != A_END[0]
    return a[np.cumsum(a_end) - a_end] * PAIR + b[np.cumsum(b_end) - b_end]


def written(found: np.ndarray, a: np.ndarray, b: np.ndarray, both: Sides) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    n_a, n_b = found[:, 1], found[:, 2]
    last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
    # A group's tokens of A come after all earlier groups' tokens of B, and its tokens of B after its own of A.
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)
    out = np.empty(len(a) + len(b), object)
    out[at_a], out[at_b] = both.decimal[","][a], both.decimal[","][b]
    out[at_a[last_a]], out[at_b[last_b]] = both.decimal["|"][a[last_a]], both.decimal[";"][b[last_b]]
    return "".join(out.tolist())[:-1]


ALIGNED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "group_ends": "array<int>", "groups": "string", "pairs": "array<long>", "times": "array<int>"}


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the alignment of each whole text, by a byte-level BPE file (A, which reads a space before the text) and a piece model (B).

    Adds counts of tokens, groups and links; ``groups``, the ids of each group
    as ``a1,a2|b1;a3|b2``; ``group_ends``, the bytes where groups end; and the
    linked id pairs (numbers ``a * PAIR + b``, ascending) with how often each
    occurs.  Texts that are null, empty or not kept byte for byte by both
    tokenizers have zeros, empty arrays and the empty string.  All rows are
    kept, repeated ones too; columns named like a new one are replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ALIGNED]
    schema = docs.select(*kept, *(F.lit(None).cast(kind).alias(name) for name, kind in ALIGNED.items())).schema

    def one(text: str | None, both: Sides) -> tuple:
        ids = tokens(text, both)
        if ids is None:
            return 0, 0, 0, 0, np.zeros(0, np.int32), "", np.zeros(0, np.int64), np.zeros(0, np.int32)
        a, b = ids
        labelled = labels(np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b]))
        found, links = groups_of(labelled), links_of(labelled, a, b)
        pairs, times = np.unique(links, return_counts=True)
        return len(a), len(b), len(found), len(links), found[:, 0].astype(np.int32), written(found, a, b, both), pairs, times.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path)
        for b in slices(batches):
            for part in _bounded(b):
                rows = [one(t, both) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = list(zip(*rows, strict=True))
                lists = [_lists(columns[i], kind) for i, kind in ((4, np.int32), (6, np.int64), (7, np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in columns[:4]), lists[0], pa.array(columns[5], pa.string()), *lists[1:]], [*kept, *ALIGNED])

    return docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about TEXT_AT_ONCE bytes of its last column: a text's alignment is many times its size."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > TEXT_AT_ONCE:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def _lists(rows: tuple, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *rows])))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, is_best)``: in how many documents two ids are linked, and whether that is the most for its id of A."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.floor(F.col("pair") / PAIR)), "pairs")
    # One row per id of A, so no more than its vocabulary holds.
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))


def linked(aligned: DataFrame, sent: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` (:func:`align`, materialised) with ``n_best`` and ``count_sum`` in place of its pairs.

    ``n_best`` counts a document's links whose id pair is linked in as many
    documents as any of its id of A; ``count_sum`` adds up, over its links, in
    how many documents their pair is linked.  The ``sent`` pairs of the most
    documents go to all tasks; rarer ones, which no document's rows can make
    hot, are looked up by a join.
    """
    spark = aligned.sparkSession
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    counts = stored(pair_counts(aligned), "counts")
    total = counts.count()
    frequent = (counts.orderBy(F.desc("n"), "pair").limit(sent) if total > sent else counts).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "is_best")))
    kept = [c for c in rows.columns if c not in ("pairs", "times", "n_best", "count_sum")]
    schema = rows.select(*kept, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), F.array().cast("array<long>").alias("pairs"), F.array().cast("array<int>").alias("times")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, is_best = known.value
        for b in slices(batches, 2_000):
            lists = b.column(b.num_columns - 2)
            ends = lists.offsets.to_numpy()
            mine, times = lists.flatten().to_numpy(), b.column(b.num_columns - 1).flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(ends))
            at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
            hit = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            sums = [np.bincount(owner[hit], weights, b.num_rows).astype(np.int64) for weights in ((times * is_best[at])[hit], (times * n[at])[hit])] if len(pair) else [np.zeros(b.num_rows, np.int64)] * 2
            rest = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=b.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit])) for x in (mine, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(s) for s in sums), *left], [*kept, "n_best", "count_sum", "pairs", "times"])

    found = rows.select(*kept, "pairs", "times").mapInArrow(run, schema)
    if total <= sent:
        return found.drop("pairs", "times", "_row")
    found = stored(found, "frequent")
    rest = found.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", "x.pairs", "x.times")
    rest = rest.join(counts.withColumnRenamed("pair", "pairs"), "pairs").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = found.join(rest, "_row", "left").withColumns({"n_best": F.col("n_best") + zero("_best"), "count_sum": F.col("count_sum") + zero("_sum")})
    return found.drop("pairs", "times", "_row", "_best", "_sum")


def cross_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT_PAIRS) -> DataFrame:
    """A row per document: counts of its alignment and links, and ``groups_sha256``, the digest of its groups (empty without tokens)."""
    rows = align(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), a_path, b_path)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = stored(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    return linked(rows, sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
