"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton holds all pieces.  It reads a text once; at each position the
output links of its state list every piece that ends there, and each relaxes
the best score of that position.  Unigram scores are those of the model file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm import pieces
from nearloom.llm.runtime import ship, slices

#: Encodings that a Python worker keeps from batch to batch, and the longest pre-token kept.
KEPT, LONG = 300_000, 64


@lru_cache(maxsize=4)
def automaton(path: str) -> ahocorasick.Automaton:
    model = pieces.load(path)
    out = ahocorasick.Automaton()
    for text, score in model.scores.items():
        out.add_word(text, (len(text), score, model.ids[text]))
    out.make_automaton()
    return out


def viterbi(word: str, model: pieces.Pieces, auto: ahocorasick.Automaton) -> list[int]:
    """Ids of the best segmentation of ``word``; of equally good ones, that with the longest last piece."""
    n = len(word)
    best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    done = 0  # positions up to here are final
    single = set()
    for end, (size, score, piece) in auto.iter(word):
        while done < end:
            done += 1
            _unknown(word, done, best, back, single, model)
        start = end + 1 - size
        if size == 1:
            single.add(end)
        score += best[start]
        if score > best[end + 1] or score == best[end + 1] and start < back[end + 1][0]:
            best[end + 1], back[end + 1] = score, (start, piece)
    while done < n:
        done += 1
        _unknown(word, done, best, back, single, model)
    out, at = [], n
    while at:
        start, piece = back[at]
        if piece >= 0:
            out.append(piece)
        elif model.byte_ids:
            out += [model.byte_ids[x] for x in reversed(word[start:at].encode("utf-8", "surrogatepass"))]
        elif not out or out[-1] != model.unknown_id:
            out.append(model.unknown_id)
        at = start
    return out[::-1]


def _unknown(word: str, end: int, best: list, back: list, single: set, model: pieces.Pieces) -> None:
    """Relax position ``end`` by an unknown character, if no piece is that character."""
    if end - 1 not in single and best[end - 1] + model.unknown_score > best[end]:
        best[end], back[end] = best[end - 1] + model.unknown_score, (end - 1, -1)


def encode_bytes(text: str | None, path: str, known: dict[str, bytes]) -> bytes:
    """The ids of ``text`` as 32-bit numbers; ``known`` keeps those of its pre-tokens."""
    model = pieces.load(path)
    words = pieces.pre_tokens(text, model)
    once: dict[str, bytes] = {}
    for word in set(words).difference(known):
        (known if len(word) <= LONG else once)[word] = np.array(viterbi(word, model, automaton(path)), np.int32).tobytes()
    if once:
        return b"".join([known[w] if w in known else once[w] for w in words])
    return b"".join(map(known.__getitem__, words))


def encode_text(text: str | None, path: str) -> list[int]:
    return np.frombuffer(encode_bytes(text, path, {}), np.int32).tolist()


@lru_cache(maxsize=4)
def _said(path: str) -> list[bytes]:
    """What each id says, as UTF-8; control pieces say nothing."""
    model = pieces.load(path)
    out = [b"" if i in model.hidden else t.encode() for i, t in enumerate(model.texts)]
    for value, i in model.byte_ids.items():
        out[i] = bytes([value])
    out[model.unknown_id] = b" \xe2\x81\x87 "
    return out


def decode_ids(ids: Iterable[int] | None, path: str) -> str:
    """The text of ``ids``: byte pieces are joined and read as UTF-8 (bad bytes: U+FFFD), unknown ids say nothing."""
    said = _said(path)
    try:
        raw = b"".join(map(said.__getitem__, ids or ()))
    except (IndexError, TypeError):
        raw = b"".join(said[i] for i in ids if i is not None and 0 <= i < len(said))
    text = raw.decode("utf-8", "replace").replace(pieces.SPACE, " ")
    return text[1:] if text.startswith(" ") and pieces.load(path).dummy_prefix else text


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the ids of each whole text; empty for null and empty texts.

    All rows and other columns are kept; a clashing column named ``ids_col``
    is replaced.  No shuffle.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids_col]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text_to_encode"))
    schema = docs.select(*kept).withColumn(ids_col, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for b in slices(batches):
            if len(known) > KEPT:
                known.clear()
            found = [encode_bytes(t, model_path, known) for t in b.column(b.num_columns - 1).to_pylist()]
            starts = np.cumsum([0, *[len(x) // 4 for x in found]])
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*kept, ids_col])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of each row's ids; empty for null and empty arrays.

    Decoding an encoded text gives the text back, except that U+2581 comes
    back as a space.
    """
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != text_col]
    ready = rows.select(*kept, F.col(ids_col).cast("array<int>").alias("_ids_to_decode"))
    schema = rows.select(*kept).withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = b.column(b.num_columns - 1).fill_null([])
            values, ends = lists.flatten(), lists.offsets.to_numpy()
            ids, ends = values.to_pylist() if values.null_count else values.to_numpy().tolist(), (ends - ends[0]).tolist()
            texts = pa.array([decode_ids(ids[i:j], model_path) for i, j in zip(ends, ends[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*kept, text_col])

    return ready.mapInArrow(run, schema)
