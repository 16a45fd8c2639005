"""Exact top-k inner products over an impact-ordered index, read score at a time.

The components of a vector are its terms.  In each block of the index every
dimension's values are quantised to impact levels, and the vectors of one
level form a posting segment.  A query visits the segments of all dimensions
by descending quantised impact, whatever their dimension, and adds to
accumulators what a member gains at least.  It stops only once the gains that
can still come prove that all but a few vectors stay below the k-th; those
few possible members are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.runtime import cut, ship

#: Vectors in a block of the index, queries in a batch, and queries that pass by a block in one task, which holds a block and a batch.
BLOCK, BATCH, LANE = 65_536, 512, 4_096
#: Impact levels of a dimension.
LEVELS = 32
#: Possible members that are few enough to be rescored, as a multiple of k.
FEW = 16


class Index(NamedTuple):
    """A block: its vectors, and for each dimension and level a posting segment."""

    ids: np.ndarray
    vectors: np.ndarray  # int64, a row per vector
    postings: np.ndarray  # positions, dimension by dimension, by ascending value
    starts: np.ndarray  # of each segment in postings, and the end
    dims: np.ndarray  # of each segment
    low: np.ndarray  # least and greatest value in each segment
    high: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> Index:
    order = np.argsort(vectors, axis=0, kind="stable")
    postings, starts, dims, low, high = [], [0], [], [], []
    for j in range(vectors.shape[1]):
        values = vectors[order[:, j], j]
        span = max(1, int(values[-1]) - int(values[0]) + 1)
        level = (values - values[0]) * levels // span if span > levels else values - values[0]
        cut = np.flatnonzero(np.diff(level, prepend=level[0] - 1, append=level[-1] + 1))
        postings.append(order[:, j])
        for a, b in zip(cut, cut[1:], strict=False):
            starts.append(starts[-1] + b - a)
            dims.append(j)
            low.append(values[a])
            high.append(values[b - 1])
    return Index(ids, vectors, np.concatenate([*postings, np.zeros(0, np.int64)]).astype(np.intp), np.array(starts), np.array(dims, np.int64), np.array(low, np.int64), np.array(high, np.int64))


def search(index: Index, query: np.ndarray, own: int, k: int, few: int = FEW) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, id)`` of a block for ``query``, ties to the smaller id, without vectors of id ``own``."""
    n = len(index.ids)
    if n == 0:
        return []
    q = query[index.dims] if len(index.dims) else np.zeros(0, np.int64)
    least, most = np.where(q >= 0, q * index.low, q * index.high), np.where(q >= 0, q * index.high, q * index.low)
    width = len(query)
    floor = np.full(width, np.iinfo(np.int64).max)
    np.minimum.at(floor, index.dims, least)
    gain, top = least - floor[index.dims], most - floor[index.dims]
    order = np.argsort(-top, kind="stable")
    totals = np.zeros(n, np.int64)
    barred = index.ids == own
    possible = np.flatnonzero(~barred)
    # Segments are read to their end before each check; before two thirds of them there is hardly ever a proof.
    stops = np.unique(np.linspace(2 * len(order) / 3, len(order), 7).astype(int))
    before = 0
    for stop in stops:
        for s in order[before:stop]:
            if gain[s]:
                totals[index.postings[index.starts[s] : index.starts[s + 1]]] += gain[s]
        before = stop
        # What each dimension can still add beyond the totals: its best unread segment, or the inner spread of a read one.
        rest = np.zeros(width, np.int64)
        np.maximum.at(rest, index.dims[order[stop:]], top[order[stop:]])
        np.maximum.at(rest, index.dims[order[:stop]], (top - gain)[order[:stop]])
        if len(possible) > k:
            seen = totals[possible]
            bar = np.partition(seen, len(seen) - k)[len(seen) - k]
            possible = possible[seen >= bar - rest.sum()]
        if len(possible) <= few * k:
            break
    scores = index.vectors[possible] @ query
    best = np.lexsort((index.ids[possible], -scores))[:k]
    return [(int(scores[i]), int(index.ids[possible[i]])) for i in best]


def whole_numbers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _sizes(column: pa.Array) -> np.ndarray:
    return pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as a matrix; shorter ones end with zeros."""
    sizes = _sizes(column)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, block: int = BLOCK, batch: int = BATCH, lane: int = LANE) -> DataFrame:
    """For each row of ``queries`` the ``k`` rows of ``vectors`` with the highest scores: ``(query_id, rank, vec_id, score)``.

    Score: the integer inner product of the components, each multiplied by
    ``scale`` and floored; ties go to the smaller id.  A query's own id is no
    candidate.  Rows without an id, null vectors and those with null or
    non-finite components take no part; of vectors of different length the
    shorter counts as ended by zeros; repeated candidates are ranked each,
    repeated queries are one, and different queries of one id are ranked each.  With fewer than ``k`` candidates all are returned.

    Vectors are dealt to blocks of bounded size.  A task builds a block's
    index once and then lets queries pass by in batches, so it holds a block
    and a batch; a block is copied and built once per ``lane`` of queries.
    The blocks' best are ranked per query.  Work is that of the stated query
    set against all rows.
    """
    ship(vectors.sparkSession)
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", whole_numbers(F.col("v"), scale).alias("v"))
    pieces = lambda df, size: max(1, -(-df.count() // size))
    rows = ready(vectors)
    asked = cut(ready(queries).distinct().withColumn("q", F.monotonically_increasing_id()))
    blocks, lanes = pieces(vectors, block), pieces(asked, lane)
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # By id and vector and a number, so that neither one id nor repeated rows fill a block of their own.
    left = rows.select(dealt(blocks, "id", "v", F.monotonically_increasing_id()).alias("b"), every(lanes).alias("s"), F.lit(-1).cast("long").alias("q"), "id", "v")
    right = asked.select(every(blocks).alias("b"), dealt(lanes, "q").alias("s"), "q", "id", "v")
    both = left.unionByName(right).repartition(blocks * lanes, "b", "s").sortWithinPartitions("b", "s", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, index, known = None, [], None, 0

        def answers(ask: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal index, known
            width = int(_sizes(ask.column(4)).max(initial=0))
            if index is None or width > known:  # shorter vectors end with zeros, so a wider query does not change them
                known = max(width, known, *(int(_sizes(b.column(4)).max(initial=0)) for b in own))
                index = build(np.concatenate([b.column(3).to_numpy() for b in own]), np.concatenate([_matrix(b.column(4), known) for b in own]))
            out = [(q, i, vec, score) for q, i, v in zip(ask.column(2).to_pylist(), ask.column(3).to_pylist(), _matrix(ask.column(4), known), strict=True) for score, vec in search(index, v, i, k)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "query_id", "vec_id", "score"])

        for whole in batches:
            keys = np.stack([whole.column(0).to_numpy(), whole.column(1).to_numpy(), whole.column(2).to_numpy() >= 0], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                if (key := tuple(keys[i][:2])) != at:
                    at, own, index, known = key, [], None, 0
                part = whole.slice(i, j - i)
                if not keys[i][2]:
                    own.append(part)
                elif own:
                    for k_ in range(0, part.num_rows, batch):
                        yield answers(part.slice(k_, batch))

    found = both.mapInArrow(run, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
