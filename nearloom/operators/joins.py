"""Exact radius and k-nearest joins of many queries with a base, pruned by the triangle inequality.

Vectors lie in cells around pivots, and a cell in rings by the distance from
its pivot; of a ring it is known how near and how far from the pivot its
vectors are.  A query at distance D from a pivot has nothing within r of it in
a ring that ends before D - r or begins after D + r, and in a ring that it does
visit only in the part between those.  For the k nearest, r is the distance of
the k-th best in the nearest rings that hold k vectors.

Rings of neighbouring cells are stored together in pieces.  A query is sent
once to each piece that holds a ring for it, however many these are, and there
it is compared with rings among others that visit them, by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import shards
from nearloom.operators.policies import Policy, Radius, TopK
from nearloom.operators.search import _NO_DOC, BATCH, BLOCK, FOUND, _docs, _Kept, _scan, matrix
from nearloom.session import ship
from nearloom.shared import stored

#: Vectors of a ring, about, and rings, at most: their bounds are sent to every task.  A larger base has larger rings.
BLOCK_ROWS, MOST_BLOCKS = 2_000, 100_000
#: Distances of queries from rings that a task holds at a time, and the share of a piece from which all of it is compared.
HELD, MOSTLY = 1 << 20, 0.5
#: Rings of a cell, about.
RINGS = 4
#: What rounding may be off by, as a share of the distances at hand.
SLACK = 1e-9

#: Spaces whose distances come of a metric: cosine is half the squared distance of unit vectors.
METRIC = ("l2", "l2_u8", "cosine")
_SCHEMA = "shard int, labels array<long>, docs array<long>, away binary, vectors binary"


@dataclass(frozen=True)
class Pivots:
    """A base in rings around pivots.  ``own``, ``low`` and ``high`` tell each ring's pivot and how far from it its vectors are, ``piece`` where they lie."""

    blocks: DataFrame
    centres: np.ndarray
    own: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    piece: np.ndarray
    space: str

    @property
    def total(self) -> int:
        return int(self.count.sum())


def _away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances, not squared, of the rows of ``x`` from ``centres``."""
    return np.sqrt(np.maximum(distances.block("l2", x, centres), 0))


def pivoted(base: DataFrame, space: str = "l2", block_rows: int = BLOCK_ROWS, seed: int = 100) -> Pivots:
    """``base (label, vector, doc_id, deleted)`` in rings around pivots that a bounded sample gives.

    Deleted rows and vectors that are not finite are left out; the vectors are
    shuffled once, to their blocks.
    """
    if space not in METRIC:
        raise ValueError(f"pruning needs a metric: one of {', '.join(METRIC)}")
    ship(base.sparkSession)
    rows = base.where(~F.col("deleted")).where(distances.finite("vector")).select("label", F.col("vector").cast("array<double>").alias("vector"), "doc_id")
    total = rows.count()
    each = max(block_rows, -(-total // MOST_BLOCKS))
    none = np.zeros(0)
    if not total:
        return Pivots(base.sparkSession.createDataFrame([], _SCHEMA), np.zeros((0, 0)), none, none, none, none, none, space)
    cells = max(1, -(-total // (each * RINGS)))
    centres = shards._means(shards._sample(rows, min(shards.SAMPLE, cells * shards.SAMPLE_EACH), space), cells, seed)
    sent = base.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), sent.value.shape[1])
            d = _away(distances.unit(x) if space == "cosine" else x, sent.value)
            cell = d.argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((distances.unit(x) if space == "cosine" else x) - sent.value[cell]) ** 2 @ np.ones(sent.value.shape[1])))], [*b.schema.names, "cell", "away"])

    placed = stored(rows.mapInArrow(place, "label long, vector array<double>, doc_id long, cell int, away double"), "pivots")
    # A cell's rings hold about as many vectors each; equal distances may fall into several.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("rings", F.ceil(F.col("n") / each).cast("int"))
    cuts = placed.join(F.broadcast(sizes), "cell").groupBy("cell", "rings").agg(F.percentile_approx("away", F.lit([i / 64 for i in range(1, 64)]), 1000).alias("marks"))
    rank = F.size(F.filter("marks", lambda m: m < F.col("away"))) / 64
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", F.least(F.floor(rank * F.least("rings", F.lit(64))), F.col("rings") - 1).cast("int"))
    ringed = ringed.withColumn("ring", F.when(F.col("rings") > 64, F.col("ring") * 1024 + F.pmod(F.xxhash64("label"), F.ceil(F.col("rings") / 64))).otherwise(F.col("ring")).cast("int"))
    bounds = stored(ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")), "rings").toPandas().sort_values(["cell", "ring"], ignore_index=True)
    # Rings in order of the neighbourhood of their cells, and pieces of as many as hold about BLOCK vectors.
    near = distances.block("l2", centres, shards._means(centres, min(len(centres), -(-total // BLOCK)), seed)).argmin(axis=1)
    bounds = bounds.iloc[np.lexsort((bounds["ring"], bounds["cell"], near[bounds["cell"]]))].reset_index(drop=True)
    bounds["piece"] = (bounds["n"].cumsum() - bounds["n"]) // max(BLOCK, each)
    number = base.sparkSession.createDataFrame(bounds[["cell", "ring", "piece"]].assign(number=range(len(bounds))).astype("int32"))

    def close(key: tuple, t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("away").to_numpy(), t.column("number").to_numpy()))
        docs, x = _docs(t.column("doc_id"))[order], matrix(t.column("vector"), None)[order]
        row = [key[0].as_py(), t.column("label").to_numpy()[order].tolist(), [None if d == _NO_DOC else d for d in docs.tolist()], t.column("away").to_numpy()[order].tobytes(), x.tobytes()]
        types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([pa.array([v], ty) for v, ty in zip(row, types, strict=True)], names=["shard", "labels", "docs", "away", "vectors"])

    pieces = bounds["piece"].nunique()
    dealt = ringed.join(F.broadcast(number), ["cell", "ring"]).select(F.col("piece").alias("shard"), "number", "label", "doc_id", "away", "vector").repartition(min(3 * pieces, shards.MOST_TASKS), "shard")
    blocks = stored(dealt.groupBy("shard").applyInArrow(close, _SCHEMA), "rings")
    return Pivots(blocks, centres, *(bounds[c].to_numpy() for c in ("cell", "low", "high", "n", "piece")), space)


def _reach(space: str, distance: np.ndarray) -> np.ndarray:
    """A distance of ``space`` as one of the metric."""
    return np.sqrt(np.maximum(2 * distance if space == "cosine" else distance, 0))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where(distances.finite("vector"))


def _least(x: np.ndarray, centres: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, space: str) -> tuple[np.ndarray, np.ndarray]:
    """For each query and ring, the least distance of any of the ring, and the distance of its pivot."""
    d = _away(distances.unit(x) if space == "cosine" else x, centres)[:, own]
    return np.maximum(np.maximum(low - d, d - high), 0), d


def _visits(asked: DataFrame, pivots: Pivots, k: int | None) -> DataFrame:
    """``asked (query_id, vector[, reach])`` with the ``shards`` to visit: the pieces that hold a ring within reach, or the nearest rings with ``k`` vectors.

    For the latter, ``near`` tells the farthest of these rings.
    """
    sent = asked.sparkSession.sparkContext.broadcast((pivots.centres, pivots.own.astype(int), pivots.low, pivots.high, np.asarray(pivots.count, int), np.asarray(pivots.piece, np.int32)))
    space = pivots.space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, own, low, high, count, piece = sent.value
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        step = max(1, HELD // len(own))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                least, d = _least(matrix(b.column("vector"), centres.shape[1]), centres, own, low, high, space)
                more = []
                if k is None:
                    wanted = least <= b.column("reach").to_numpy()[:, None] + SLACK * (1 + d)
                else:
                    # Nearest by where the middle of a ring may be: any rings that hold k vectors give a bound.
                    least += d / 1e6
                    order = np.argsort(least, axis=1, kind="stable")
                    last = (np.cumsum(count[order], axis=1) < k).sum(axis=1)
                    near = np.take_along_axis(least, np.take_along_axis(order, last[:, None], axis=1), axis=1)
                    wanted, more = least <= near, [pa.array(near[:, 0])]
                at, to = np.divmod(np.flatnonzero(np.logical_or.reduceat(wanted, first, axis=1)), len(first))
                ends = np.searchsorted(at, np.arange(b.num_rows + 1))
                shards = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(piece[first][to]))
                yield pa.RecordBatch.from_arrays([*b.columns, *more, shards], [*b.schema.names, *["near"][: len(more)], "shards"])

    if k is not None:
        schema = asked.withColumns({"near": F.lit(0.0), "shards": F.array().cast("array<int>")}).schema
    else:
        schema = asked.withColumn("shards", F.array().cast("array<int>")).schema
    return asked.mapInArrow(run, schema)


def _join(pivots: Pivots, asked: DataFrame, policy: Policy, k: int | None) -> DataFrame:
    """``FOUND`` and ``computed``: the best of each visit of ``asked``; within ``reach`` if it has one."""
    space = pivots.space

    def answer(block: dict[str, Any], asked: dict[str, np.ndarray]) -> pa.RecordBatch:
        labels = np.array(block["labels"], np.int64)
        docs = np.array([_NO_DOC if d is None else d for d in block["docs"]], np.int64)
        away, x = np.frombuffer(block["away"]), np.frombuffer(block["vectors"]).reshape(len(labels), -1)
        kept, counts = [_Kept() for _ in asked["query_id"]], np.zeros((len(asked["query_id"]), 1), np.int64)
        first, last = np.searchsorted(piece, [block["shard"], block["shard"] + 1])
        mine = slice(first, last)
        ends = np.cumsum([0, *count[mine]])
        cells, cell = np.unique(own[mine], return_inverse=True)
        for i in range(0, len(kept), BATCH):
            q, to = asked["vector"][i : i + BATCH], kept[i : i + BATCH]
            least, d = _least(q, centres[cells], cell, low[mine], high[mine], space)
            slack = SLACK * (1 + d)
            if k is None:
                reach = asked["reach"][i : i + BATCH]
                wanted, bound = least <= reach[:, None] + slack, reach * reach / (2 if space == "cosine" else 1)
            else:
                wanted, bound = least + d / 1e6 <= asked["near"][i : i + BATCH][:, None] + slack, None
            if (wanted @ np.diff(ends)).sum() >= MOSTLY * len(q) * len(labels):
                _scan(to, q, labels, docs, x, space, policy, bound)
                counts[i : i + BATCH, 0] = len(labels)
                continue
            for r in np.flatnonzero(wanted.any(axis=0)).tolist():
                at = np.flatnonzero(wanted[:, r])
                begin, end = ends[r], ends[r + 1]
                if k is None:  # the part of the ring that is within reach of any of them
                    spare = reach[at] + 4 * slack[at, r]
                    begin, end = begin + np.searchsorted(away[begin:end], [(d[at, r] - spare).min(), np.nextafter((d[at, r] + spare).max(), np.inf)])
                if end > begin:
                    _scan([to[j] for j in at.tolist()], q[at], labels[begin:end], docs[begin:end], x[begin:end], space, policy, None if bound is None else bound[at])
                    counts[i + at, 0] += end - begin
        return shards.counted(asked["query_id"], kept, counts, ["computed"])

    own, low, high, count, piece, centres = pivots.own.astype(int), pivots.low, pivots.high, np.asarray(pivots.count, int), pivots.piece, pivots.centres
    return shards.meet(pivots.blocks, _visits(asked, pivots, k), answer, f"{FOUND}, computed long")


def _chosen(found: DataFrame, policy: Policy, metrics: Observation | None) -> DataFrame:
    if metrics is not None:
        found = found.observe(metrics, F.coalesce(F.sum("computed"), F.lit(0)).alias("computed"))
    return policy.choose(found.where("label IS NOT NULL").drop("computed")).select("query_id", "rank", "label", "doc_id", "distance")


def _nothing(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], "query_id long, rank int, label long, doc_id long, distance double")


def radius_join(pivots: Pivots, queries: DataFrame, epsilon: float, most: int | None = None, metrics: Observation | None = None) -> DataFrame:
    """All of the base within ``epsilon`` of each query (squared for ``l2``), or the nearest ``most``: ``(query_id, rank, label, doc_id, distance)``.

    ``metrics`` gets ``computed``, the pairs whose distance was taken.
    """
    if not pivots.total:
        return _nothing(queries)
    policy = Radius(epsilon, most)
    reach = float(_reach(pivots.space, np.array([max(epsilon, 0.0)]))[0])
    return _chosen(_join(pivots, _asked(queries).withColumn("reach", F.lit(reach)), policy, None), policy, metrics)


def knn_join(pivots: Pivots, queries: DataFrame, k: int, metrics: Observation | None = None) -> DataFrame:
    """The ``k`` nearest of the base for each query, exactly; ties to the smaller label.

    The rings nearest to a query that hold ``k`` vectors tell how far the
    ``k``-th can be at most; then only what may be within that is compared.
    ``metrics`` gets ``computed`` pairs of both steps.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not pivots.total:
        return _nothing(queries)
    asked, policy, space = stored(_asked(queries), "asked"), TopK(k), pivots.space
    rough = stored(_join(pivots, asked, policy, min(k, pivots.total)), "rough")
    kth = policy.choose(rough.where("label IS NOT NULL").drop("computed")).groupBy("query_id").agg(F.max("distance").alias("kth"), F.count("*").alias("n"))
    # Fewer than k in all: nothing bounds the distance.
    reach = F.when(F.col("n") >= min(k, pivots.total), F.sqrt(F.greatest(F.lit(2.0 if space == "cosine" else 1.0) * F.col("kth"), F.lit(0.0)))).otherwise(float("inf"))
    bounded = asked.join(kth, "query_id").select("query_id", "vector", reach.alias("reach"))
    found = _join(pivots, bounded, policy, None)
    if metrics is not None:
        # The first step's pairs are counted with the second's, as rows of no label.
        found = found.unionByName(rough.groupBy("query_id").agg(F.sum("computed").alias("computed")), allowMissingColumns=True)
    return _chosen(found, policy, metrics)
