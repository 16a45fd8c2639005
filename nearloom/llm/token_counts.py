"""Token counts of texts under a unigram model, by forward scores shared along a trie of pre-tokens.

The best segmentation of a text is found pre-token by pre-token, and the
forward score at a position depends only on the characters before it.  So
the distinct pre-tokens of a batch are inserted in a trie, each node gets its
best score and token count once, for all pre-tokens that share the prefix,
and nodes at which a pre-token ends store its count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm import pieces
from nearloom.llm.runtime import ship, slices

#: Rows whose new pre-tokens share a trie.
TRIE_ROWS = 1024
#: Terminal counts that a Python worker keeps from batch to batch.
KEPT = 500_000
#: A longer pre-token (a text without spaces) is counted alone and not kept.
LONG = 256


def _backward(model: pieces.Pieces) -> dict:
    """A trie of all pieces from their ends; a piece's score is stored under the empty string."""
    found = _tries.get(id(model))
    if found is None or found[0] is not model:
        root: dict = {}
        for text, score in model.scores.items():
            node = root
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = score
        found = _tries[id(model)] = (model, root)
    return found[1]


_tries: dict[int, tuple[pieces.Pieces, dict]] = {}


def count_all(words: Iterable[str], model: pieces.Pieces) -> dict[str, int]:
    """Token counts of distinct ``words``.

    Sorted words visit their trie depth first: the stack holds the forward
    scores of the path to the current node, and a word adds only the nodes
    past the prefix that it shares with the one before.  Of equally good
    segmentations the one whose last piece is longest counts, at every node.
    """
    scores, unknown, backward = model.scores, model.unknown_score, _backward(model)
    best, counts, path = [0.0], [0], ""
    out = {}
    for word in sorted(words):
        shared = 0
        for a, b in zip(path, word, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], counts[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n, node = float("-inf"), 0, backward
            for start in range(end - 1, -1, -1):  # shorter pieces first, up to where no piece ends like this
                node = node.get(word[start])
                if node is None:
                    break
                score = node.get("")
                if score is not None:
                    score += best[start]
                    if score >= top:
                        top, n = score, counts[start] + 1
            char = word[end - 1]
            if char not in scores and best[end - 1] + unknown > top:
                top, n = best[end - 1] + unknown, counts[end - 1] + (len(char.encode("utf-8", "surrogatepass")) if model.byte_ids else 1)
            best.append(top)
            counts.append(n)
        out[word], path = counts[-1], word
    return out


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``count_col`` (long): the tokens of each whole text; 0 for null and empty texts.

    A character that no piece holds counts as its UTF-8 bytes if the model
    has byte pieces, else as one.  All rows and other columns are kept; a
    clashing column named ``count_col`` is replaced.  No shuffle: each task
    builds the tries of its own batches.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != count_col]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text_to_count"))
    schema = docs.select(*kept).withColumn(count_col, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.load(model_path)
        known: dict[str, int] = {}
        for b in slices(batches, TRIE_ROWS):
            texts = [pieces.pre_tokens(t, model) for t in b.column(b.num_columns - 1).to_pylist()]
            if len(known) > KEPT:
                known.clear()
            long = {w for words in texts for w in words if len(w) > LONG}
            new = {w for words in texts for w in words}.difference(known, long)
            known.update(count_all(new, model))
            once = count_all(long, model) if long else {}
            get = known.__getitem__ if not long else lambda w, once=once: once[w] if w in once else known[w]
            counts = np.fromiter((sum(map(get, words)) for words in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts)], [*kept, count_col])

    return rows.mapInArrow(run, schema)
