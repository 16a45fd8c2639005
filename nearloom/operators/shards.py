"""Proximity graphs in routed shards, stored as compact blocks that can be searched and changed where they lie.

Vectors are dealt to shards by the nearest of some centres, which are fitted
so that no shard grows far beyond its size.  The centres have a small graph of
their own: it is the upper part of the search, which finds the few shards that
a query visits; their graphs are the lower part.  A shard is one row, a block:
its labels, vectors and links as arrays and bytes.  A search sends its queries
to the blocks and shuffles neither vectors nor links.  A change rewrites the
blocks that it touches, by insertion, removal and mending of links, not by
building them again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import search as exact
from nearloom.operators.graph import Graph, levels_of
from nearloom.operators.policies import Policy, Radius, TopK
from nearloom.operators.search import _NO_DOC, BATCH, FOUND, LANE, PIECES, SENT_QUERIES, SENT_VALUES, _docs, _Kept, _rows, _scan, matrix
from nearloom.operators.snapshots import GONE, Layer, Layered, Store, small
from nearloom.session import ship
from nearloom.shared import stored

#: Vectors of a shard, about; a shard with more than twice as many is split.
SHARD = 5_000
#: Vectors that centres are fitted on, at most, per centre and in all: those with the smallest hashes of their labels.
SAMPLE_EACH, SAMPLE = 100, 100_000
#: Shards, at most: their centres are sent to every task.  A larger base has larger shards.
MOST_SHARDS = 50_000
#: Labels that may be sent to every task because a search must not return them.
SENT_LABELS = 2_000_000
#: The share of shards that a query visits unless it says otherwise, and the fewest.
VISITED, FEWEST = 0.2, 4
#: The recall that :func:`fitted` looks for, and the vectors of the base that it is measured on: those with the smallest hashes of their labels.
GOAL, TRIALS = 0.97, 250
#: Rows per width of a beam up to which a beam would compute most distances of a graph, so that its rows are scanned.
SCANNED = 7
#: Queries from which a block has so many that they are answered together, and rows per width of a beam up to which a scan by matrix products then takes less time
#: than their beams: a width of a beam takes some 50 us of a query, a row of a scan some 20 ns.
TOGETHER, SCANNED_TOGETHER = 32, 1_000
#: Rows of the shards that make a piece, about, if queries are too many to be sent.
PIECE = 65_536
#: Tasks that build or change shards, at most.
MOST_TASKS = 20_000
#: Shards whose numbers are pushed into the scan of the blocks.
PUSHED = 1_000

BLOCK = "shard int, n int, top int, labels array<long>, docs array<long>, vectors binary, heads binary, ends binary, computed long"
_BLOCK = pa.schema(
    [("shard", pa.int32()), ("n", pa.int32()), ("top", pa.int32()), ("labels", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("vectors", pa.binary()), ("heads", pa.binary()), ("ends", pa.binary()), ("computed", pa.int64())]
)


@dataclass(frozen=True)
class Params:
    """How a shard's graph is built and read."""

    space: str | distances.Distance
    links: int = 16
    ef_construction: int = 200
    seed: int = 100
    shard_rows: int = SHARD


@dataclass(frozen=True)
class Shards:
    """A base as routed shards: the blocks, and the centre of each shard number (row ``i`` is shard ``i``'s; not finite: it has none)."""

    blocks: Layered
    centres: np.ndarray
    params: Params

    @cached_property
    def held(self) -> np.ndarray:
        """The numbers of shards that vectors may go to."""
        return np.flatnonzero(np.isfinite(self.centres).all(axis=1))

    @cached_property
    def router(self) -> Graph:
        """The graph over the centres, the upper part of every search."""
        return Graph(self.centres[self.held], "l2" if self.params.space == "cosine" else self.params.space, 12, 80)

    def probes(self, asked: int | None) -> int:
        """How many shards a query visits."""
        return min(len(self.held), max(FEWEST, math.ceil(len(self.held) * VISITED)) if asked is None else max(1, asked))


def _block(shard: int, labels: np.ndarray, docs: np.ndarray, g: Graph) -> pa.Table:
    top, heads, ends = g.pack()
    row = [shard, len(labels), top, labels.tolist(), [None if d == _NO_DOC else d for d in docs.tolist()], g.x.astype("<f8").tobytes(), heads, ends, g.computed]
    return pa.table([pa.array([v], t) for v, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)


def _opened(block: dict[str, Any], params: Params) -> tuple[np.ndarray, np.ndarray, Graph]:
    """The labels, documents and graph of a block."""
    labels = np.array(block["labels"], np.int64)
    docs = np.array([_NO_DOC if d is None else d for d in block["docs"]], np.int64)
    x = np.frombuffer(block["vectors"], "<f8").reshape(len(labels), -1)
    return labels, docs, Graph.packed(x, params.space, params.links, params.ef_construction, block["top"], block["heads"], block["ends"])


def _means(x: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of at most ``cells`` cells of ``x``; equal rows share one."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([distances.block("l2", part, centres).argmin(axis=1) for part in np.array_split(x, max(1, len(x) * len(centres) // 8_000_000))])
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _sample(rows: DataFrame, most: int, space: str | distances.Distance) -> np.ndarray:
    got = rows.orderBy(F.xxhash64("label"), "label").limit(most).select(F.col("vector").cast("array<double>").alias("vector")).toArrow()
    x = matrix(got.column("vector"), None)
    return distances.unit(x) if space == "cosine" and len(x) else x


def _route(g: Graph, x: np.ndarray, probes: int, space: str | distances.Distance) -> np.ndarray:
    """The ``probes`` shards nearest to each row of ``x``."""
    if space == "cosine":
        x = distances.unit(x)
    if probes >= len(g.x):
        return np.tile(np.arange(len(g.x)), (len(x), 1))
    out = np.zeros((len(x), probes), np.int64)
    width = max(2 * probes, 40)
    if len(g.x) <= SCANNED * width:
        step = max(1, 8_000_000 // len(g.x))
        return np.concatenate([np.zeros((0, probes), np.int64), *(np.argpartition(distances.block(g.space, x[i : i + step], g.x), probes - 1, axis=1)[:, :probes] for i in range(0, len(x), step))])
    for i, q in enumerate(x):
        near = g.search(q, width)[:probes]
        if len(near) < probes:  # a part of the graph that the beam does not reach
            near = np.argsort(distances.exact(g.space, q, g.x), kind="stable")[:probes]
        out[i] = near
    return out


def _placed(rows: DataFrame, centres: np.ndarray, space: str | distances.Distance) -> DataFrame:
    """``rows`` with the ``shard`` of the nearest centre; by one matrix product per batch, without a shuffle."""
    held = np.flatnonzero(np.isfinite(centres).all(axis=1))
    sent = rows.sparkSession.sparkContext.broadcast((centres[held], held.astype(np.int32)))
    schema = rows.withColumn("shard", F.lit(None).cast("int")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, held = sent.value
        for b in batches:
            x = matrix(b.column("vector"), centres.shape[1])
            near = distances.block("l2", distances.unit(x) if space == "cosine" else x, centres).argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held[near])], [*b.schema.names, "shard"])

    return rows.mapInArrow(run, schema)


def _centres(rows: DataFrame, shard_rows: int, params: Params, shards: int) -> tuple[np.ndarray, DataFrame]:
    """Balanced centres, and ``rows`` placed by them: cells with more than twice their share get centres of their own."""
    centres = _means(_sample(rows, min(SAMPLE, shards * SAMPLE_EACH), params.space), shards, params.seed)
    placed = stored(_placed(rows, centres, params.space), "placed")
    for _ in range(4):
        sizes = dict(placed.groupBy("shard").count().where(F.col("count") > 2 * shard_rows).collect())  # a row per overfull cell
        if not sizes or len(centres) >= MOST_SHARDS:
            break
        more, of = [], min(SAMPLE, sum(-(-n // shard_rows) for n in sizes.values()) * SAMPLE_EACH)
        sampled = placed.where(F.col("shard").isin(list(sizes))).orderBy(F.xxhash64("label"), "label").limit(of).select("shard", "vector").toArrow()
        own, x = sampled.column("shard").to_numpy(), matrix(sampled.column("vector"), None)
        x = distances.unit(x) if params.space == "cosine" else x
        for shard, n in sizes.items():
            mine = x[own == shard]
            if len(mine):
                more.append(_means(mine, -(-n // shard_rows), params.seed))
        kept = np.delete(centres, [s for s in sizes if (own == s).any()], axis=0)
        fuller = np.concatenate([kept, *more])
        if len(fuller) == len(centres):  # equal vectors: no centre parts them
            break
        centres = fuller
        placed = stored(_placed(placed.drop("shard"), centres, params.space), "placed")
    return centres, placed


def build(rows: DataFrame, space: str | distances.Distance = "l2", links: int = 16, ef_construction: int = 200, seed: int = 100, shard_rows: int | None = None) -> Shards:
    """The shards of all ``rows (label, vector, doc_id)``, deleted ones too: a search passes through them.

    The vectors are shuffled once, to their shards.  A shard of equal
    vectors, which no centre parts, is dealt to several that share a centre.
    An empty base has one empty shard.
    """
    ship(rows.sparkSession)
    each = SHARD if shard_rows is None else shard_rows
    params = Params(space, links, ef_construction, seed, each)
    rows = rows.select("label", F.col("vector").cast("array<double>").alias("vector"), "doc_id").where(distances.finite("vector"))
    total = rows.count()
    if not total:
        return Shards(_blocks(rows.sparkSession.createDataFrame([], BLOCK)), np.zeros((1, 0)), params)
    centres, placed = _centres(rows, each, params, min(MOST_SHARDS, max(1, -(-total // each))))
    each = max(each, -(-total // MOST_SHARDS))
    parts = [(r["shard"], -(-r["count"] // (2 * each))) for r in placed.groupBy("shard").count().collect()]
    extra = {}
    for shard, n in parts:
        for part in range(1, n):
            extra[shard, part] = len(centres)
            centres = np.concatenate([centres, centres[shard : shard + 1]])
    if extra:
        part = F.pmod(F.xxhash64("label"), F.coalesce(F.create_map(*[F.lit(v) for s, n in parts if n > 1 for v in (s, n)])[F.col("shard")], F.lit(1)))
        again = F.create_map(*[F.lit(v) for (s, p), to in extra.items() for v in (f"{s}:{p}", to)])
        placed = placed.withColumn("shard", F.coalesce(again[F.concat_ws(":", F.col("shard"), part)], F.col("shard")).cast("int"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        labels, docs, x = _sorted(t)
        return _block(key[0].as_py(), labels, docs, Graph(x, space, links, ef_construction, levels_of(labels, links, seed)))

    # So many partitions that a task has few shards, and their number said: small ones would be put into one task.
    dealt = placed.repartition(min(3 * len(centres), MOST_TASKS), "shard")
    return Shards(_blocks(dealt.groupBy("shard").applyInArrow(run, BLOCK)), centres, params)


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(t.column("label").to_numpy(), kind="stable")
    return t.column("label").to_numpy()[order], _docs(t.column("doc_id"))[order], matrix(t.column("vector"), None)[order]


def _blocks(rows: DataFrame) -> Layered:
    rows = stored(rows, "blocks")
    return Layered("shard", Layer(rows, rows.count()))


def members(shards: Shards) -> DataFrame:
    """``(shard, label)``; reads the blocks' labels alone."""
    return shards.blocks.rows.select("shard", F.explode("labels").alias("label"))


def changed(shards: Shards, written: DataFrame | None = None, gone: DataFrame | None = None) -> Shards:
    """``shards`` after ``written (label, vector, doc_id)`` are inserted or moved and the labels of ``gone`` taken out.

    A vector goes to the shard of its nearest centre.  What leaves a shard is
    unlinked there and its neighbours are mended; what stays in one is mended
    and linked anew.  Only the blocks that are touched are read whole and
    written; a block that has grown beyond twice its size is split.
    """
    spark, params = shards.blocks.base.rows.sparkSession, shards.params
    ship(spark)
    none = spark.createDataFrame([], "label long, vector array<double>, doc_id long")
    written = none if written is None else written.select("label", F.col("vector").cast("array<double>").alias("vector"), "doc_id")
    gone = none.select("label") if gone is None else gone.select("label")
    if not shards.centres.shape[1]:  # nothing yet
        return build(written, params.space, params.links, params.ef_construction, params.seed, params.shard_rows)
    moves = stored(_placed(written, shards.centres, params.space).unionByName(gone.select("label", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("shard"))), "moves")
    count = moves.count()
    if not count:
        return shards
    held = stored(members(shards).join(small(moves.select("label").distinct(), count), "label", "left_semi"), "held")
    # What a shard holds and does not keep leaves it.
    leaves = held.withColumnRenamed("shard", "old").join(moves, "label").where(F.col("shard").isNull() | (F.col("shard") != F.col("old")))
    leaves = leaves.select("label", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("long").alias("doc_id"), F.col("old").alias("shard"))
    steps = stored(moves.where("shard IS NOT NULL").unionByName(leaves), "steps")
    touched = steps.select("shard").distinct()
    few = touched.count()
    blocks = shards.blocks.rows.join(F.broadcast(touched) if few <= MOST_SHARDS else touched, "shard", "left_semi")

    def run(key: tuple, own: pa.Table, steps: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        new = steps.filter(pa.compute.is_valid(steps.column("vector")))
        out = steps.filter(pa.compute.is_null(steps.column("vector"))).column("label").to_numpy()
        labels, docs, x = _sorted(new) if new.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)))
        if not own.num_rows:
            return _block(shard, labels, docs, Graph(x, params.space, params.links, params.ef_construction, levels_of(labels, params.links, params.seed)))
        mine, mine_docs, g = _opened(own.to_pylist()[0], params)
        leave = np.flatnonzero(np.isin(mine, out))
        if len(leave):
            stay = g.remove(leave)
            mine, mine_docs = mine[stay], mine_docs[stay]
        at = {label: i for i, label in enumerate(mine.tolist())}
        known = np.array([label in at for label in labels.tolist()], bool)
        nodes = np.array([at[label] for label in labels[known].tolist()], np.int64)
        if len(nodes):
            g.update(nodes, x[known])
            mine_docs[nodes] = docs[known]
        if not known.all():
            fresh = labels[~known]
            g.insert(x[~known], levels_of(fresh, params.links, params.seed))
            mine, mine_docs = np.concatenate([mine, fresh]), np.concatenate([mine_docs, docs[~known]])
        return _block(shard, mine, mine_docs, g)

    tasks = min(3 * few, MOST_TASKS)
    again = blocks.repartition(tasks, "shard").groupBy("shard").cogroup(steps.repartition(tasks, "shard").groupBy("shard")).applyInArrow(run, BLOCK)
    return _split(replace(shards, blocks=shards.blocks.changed(again.withColumn(GONE, F.col("n") == 0), few)))


def _split(shards: Shards) -> Shards:
    """``shards`` whose overfull blocks, if any, are dealt to more centres and built anew."""
    sizes = shards.blocks.rows.select("shard", "n")
    p, first = shards.params, len(shards.centres)
    over = [r["shard"] for r in sizes.where(F.col("n") > 2 * p.shard_rows).collect()]
    if not over or first >= MOST_SHARDS:
        return shards
    parts = build(rows(shards, over), p.space, p.links, p.ef_construction, p.seed, p.shard_rows)
    if len(parts.centres) <= len(over):
        return shards
    # The old numbers stay with centres that no vector is near to, so that all others keep theirs.
    centres = np.concatenate([shards.centres, parts.centres])
    centres[over] = np.inf
    gone = shards.blocks.rows.where(F.col("shard").isin(over)).select("shard").withColumn(GONE, F.lit(True))
    moved = parts.blocks.rows.withColumns({"shard": (F.col("shard") + first).cast("int"), GONE: F.lit(False)})
    return replace(shards, blocks=shards.blocks.changed(moved.unionByName(gone, allowMissingColumns=True)), centres=centres)


def rows(shards: Shards, only: list[int] | None = None) -> DataFrame:
    """``(label, vector, doc_id)`` of all shards or of some, read from their blocks."""
    blocks = shards.blocks.rows if only is None else shards.blocks.rows.where(F.col("shard").isin(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                x = np.frombuffer(block["vectors"], "<f8").reshape(len(block["labels"]), -1)
                yield pa.RecordBatch.from_arrays([pa.array(block["labels"], pa.int64()), pa.array(list(x), pa.list_(pa.float64())), pa.array(block["docs"], pa.int64())], ["label", "vector", "doc_id"])

    return blocks.select("labels", "vectors", "docs").mapInArrow(run, "label long, vector array<double>, doc_id long")


def edges(shards: Shards) -> DataFrame:
    """``(shard, level, src, dst)``: every list of links, by labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                labels = np.array(block["labels"], np.int64)
                heads, ends = np.frombuffer(block["heads"], np.int32).reshape(-1, 3), np.frombuffer(block["ends"], np.int32)
                dst = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(heads[:, 2])]).astype(np.int32)), pa.array(labels[ends]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), block["shard"], np.int32)), pa.array(heads[:, 0]), pa.array(labels[heads[:, 1]]), dst], ["shard", "level", "src", "dst"])

    return shards.blocks.rows.select("shard", "labels", "heads", "ends").mapInArrow(run, "shard int, level int, src long, dst array<long>")


def search(shards: Shards, queries: DataFrame, policy: Policy, ef: int = 10, probes: int | None = None, hidden: DataFrame | None = None, metrics: Observation | None = None) -> DataFrame:
    """``(query_id, rank, label, doc_id, distance)`` by beam search in the ``probes`` shards nearest to each query.

    ``ef`` is the width of the beam in each shard; a shard with so few rows
    that the beam would pass by most of them is scanned, and so is one that
    many queries visit together, if that takes less time.  Labels of ``hidden`` are
    passed through but neither returned nor counted.  ``metrics`` gets
    ``visits`` of shards, ``hops`` and ``computed`` distances.  Queries up to
    SENT_QUERIES are sent to the blocks; more pass by pieces of many shards,
    and a piece is copied once per LANE of queries.
    """
    ship(queries.sparkSession)
    spark, params, n = queries.sparkSession, shards.params, shards.probes(probes)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where(distances.finite("vector"))
    if not shards.centres.shape[1]:
        return spark.createDataFrame([], "query_id long, rank int, label long, doc_id long, distance double")
    blocks, barred = _barred(shards.blocks.rows.drop("n", "computed"), shards, hidden)

    def opened(block: dict[str, Any], together: bool) -> tuple[np.ndarray, np.ndarray, Graph, np.ndarray | None, bool]:
        """A block's labels, documents, graph, which of them may be found, and whether by a beam."""
        beam = len(block["labels"]) > (SCANNED_TOGETHER if together else SCANNED) * ef
        labels, docs, g = _opened(block if beam else block | {"heads": b"", "ends": b""}, params)
        ok = None
        if barred is not None:
            ok = ~_among(labels, barred.value)
        elif block.get("hidden"):
            ok = ~np.isin(labels, np.array(block["hidden"], np.int64))
        if not beam and ok is not None:
            labels, docs, g.x = labels[ok], docs[ok], g.x[ok]
        return labels, docs, g, ok, beam

    def visit(own: tuple, vectors: np.ndarray, kept: list[_Kept]) -> np.ndarray:
        """Add to each query's best what a block has; ``(visits, hops, computed)`` of each."""
        labels, docs, g, ok, beam = own
        counts = np.zeros((len(vectors), 3), np.int64)
        if not beam:
            counts[:] = 1, 0, len(labels)
            _scan(kept, vectors, labels, docs, g.x, params.space, policy, policy.epsilon if isinstance(policy, Radius) else None)
            return counts
        for i, v in enumerate(vectors):
            before = g.hops, g.computed
            near = g.search(v, ef, ok, policy, docs)
            counts[i] = 1, g.hops - before[0], g.computed - before[1]
            kept[i].add(labels[near], docs[near], distances.exact(params.space, v, g.x[near]), policy)
        return counts

    names = ["visits", "hops", "computed"]

    def answer(block: dict[str, Any], asked: dict[str, np.ndarray]) -> pa.RecordBatch:
        kept = [_Kept() for _ in asked["query_id"]]
        return counted(asked["query_id"], kept, visit(opened(block, len(kept) >= TOGETHER), asked["vector"], kept), names)

    schema = f"{FOUND}, visits long, hops long, computed long"
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if size[0] <= SENT_QUERIES and size[1] <= SENT_VALUES:
        found = meet(blocks, _routed(asked, shards, n), answer, schema)
    else:
        # Links that no beam will follow are not copied.
        linked = F.size("labels") > SCANNED_TOGETHER * ef
        blocks = blocks.withColumns({c: F.when(linked, F.col(c)) for c in ("heads", "ends")})
        found = _by_pieces(shards, blocks, asked, n, size[0], opened, visit, names, schema)
    if metrics is not None:
        found = found.observe(metrics, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    return policy.choose(found.where("label IS NOT NULL").drop(*names)).select("query_id", "rank", "label", "doc_id", "distance")


def _by_pieces(shards: Shards, blocks: DataFrame, asked: DataFrame, probes: int, count: int, opened: Callable, visit: Callable, names: list[str], schema: str) -> DataFrame:
    """What ``visit`` finds in the blocks for more queries than can be sent.

    Consecutive shards make a piece.  A query is sent once to each piece that
    has any of its ``probes`` shards, with a bit for each shard there, however
    many it visits, and has one prefix from each.  A task takes in the blocks
    of a piece and then lets batches of queries pass by.
    """
    rows = np.zeros(len(shards.centres), np.int64)
    sizes = shards.blocks.rows.select("shard", "n").toArrow()
    rows[sizes.column("shard").to_numpy()] = sizes.column("n").to_numpy()
    piece = (np.cumsum(rows) - rows) // PIECE
    piece = np.cumsum(np.diff(piece, prepend=0) > 0)  # without numbers that no shard has
    starts = np.searchsorted(piece, np.arange(piece[-1] + 2))
    pieces, params = len(starts) - 1, shards.params
    lanes = max(1, -(-count // LANE), min(-(-PIECES * blocks.sparkSession.sparkContext.defaultParallelism // pieces), count // BATCH))
    sent = blocks.sparkSession.sparkContext.broadcast((shards.router, shards.held, starts))
    dealt = asked.withColumn("s", F.pmod(F.xxhash64("query_id"), F.lit(lanes)).cast("int"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, starts = sent.value
        step = max(1, 32_000_000 // int(starts[-1]))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                x = matrix(b.column(1), g.x.shape[1])
                visits = np.zeros((len(x), starts[-1]), bool)
                visits[np.arange(len(x))[:, None], held[_route(g, x, probes, params.space)]] = True
                for p in range(len(starts) - 1):
                    mine = visits[:, starts[p] : starts[p + 1]]
                    at = np.flatnonzero(mine.any(axis=1))
                    bits = pa.array([m.tobytes() for m in np.packbits(mine[at], axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), *(b.column(c).take(pa.array(at)) for c in (2, 0, 1)), bits], ["p", "s", "id", "vector", "visits"])

    right = dealt.mapInArrow(deal, "p int, s int, id long, vector array<double>, visits binary").withColumn("ask", F.lit(1))
    number = blocks.sparkSession.createDataFrame(pa.table({"shard": pa.array(range(len(piece)), pa.int32()), "p": pa.array(piece, pa.int32())}))
    left = blocks.join(F.broadcast(number), "shard").withColumns({"s": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), "ask": F.lit(0)})
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.repartitionById(pieces * lanes, F.col("p") * lanes + F.col("s")).sortWithinPartitions("p", "s", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, now, own = sent.value[2], None, {}
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("p", "s", "ask")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                b, (p, s, ask) = whole.slice(i, j - i), keys[i].tolist()
                if (p, s) != now:
                    now, own = (p, s), {}
                if not ask:
                    for r in range(b.num_rows):
                        block = b.slice(r, 1).to_pylist()[0]
                        own[block["shard"] - int(starts[p])] = opened(block, True)
                    continue
                ids, x = b.column("id").to_numpy(), matrix(b.column("vector"), None)
                visits = np.unpackbits(np.frombuffer(b"".join(b.column("visits").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)
                kept, counts = [_Kept() for _ in ids], np.zeros((len(ids), 3), np.int64)
                for r, block in own.items():
                    at = np.flatnonzero(visits[:, r])
                    if len(at):
                        counts[at] += visit(block, x[at], [kept[q] for q in at.tolist()])
                yield counted(ids, kept, counts, names)

    return both.mapInArrow(run, schema)


def counted(ids: np.ndarray, kept: list[_Kept], counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The rows of ``kept`` with a query's ``counts`` in its first; a query without any has a row of nulls for them."""
    found, sizes = _rows(ids, kept), np.array([len(k.label) for k in kept], np.int64)
    first = np.zeros((found.num_rows, len(names)), np.int64)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = counts[sizes > 0]
    empty = pa.array(ids[sizes == 0])
    columns = [pa.concat_arrays([c, empty if i == 0 else pa.nulls(len(empty), c.type)]) for i, c in enumerate(found.columns)]
    both = np.concatenate([first, counts[sizes == 0]])
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(both[:, i]) for i in range(len(names)))], [*found.schema.names, *names])


def meet(blocks: DataFrame, routed: DataFrame, answer: Callable[[dict[str, Any], dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``answer`` says of each block (a row with its number in ``shard``) and the queries that visit it.

    ``routed`` holds ``(query_id, vector, ..., shards)``: a query visits the
    blocks of ``shards``; the columns between are numbers that go with it.  Up to
    SENT_QUERIES queries are sent to the blocks, which are read where they
    lie; more are dealt to them, and a block once per LANE of its queries.
    """
    spark = blocks.sparkSession
    names = [c for c in routed.columns if c != "shards"]
    columns = lambda t: {c: matrix(t.column(c), None) if c == "vector" else t.column(c).to_numpy() for c in names}
    routed = stored(routed, "routed")
    size = routed.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if size[0] <= SENT_QUERIES and size[1] <= SENT_VALUES:
        got = routed.toArrow()
        to = got.column("shards").combine_chunks()
        owner, shard = np.repeat(np.arange(got.num_rows), np.diff(to.offsets.to_numpy())), to.flatten().to_numpy()
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        wanted = {int(shard[part[0]]): owner[part] for part in np.split(order, cuts) if len(part)}
        sent = spark.sparkContext.broadcast((columns(got), wanted))
        near = blocks.where(F.col("shard").isin(list(wanted))) if len(wanted) <= PUSHED else blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, wanted = sent.value
            for b in batches:
                for i in range(b.num_rows):
                    block = b.slice(i, 1).to_pylist()[0]
                    mine = wanted.get(block["shard"])
                    if mine is not None:
                        yield answer(block, {k: v[mine] for k, v in asked.items()})

        return near.mapInArrow(run, schema)
    visits = routed.withColumn("shard", F.explode("shards")).drop("shards")
    lanes = visits.groupBy("shard").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    visits = visits.join(F.broadcast(lanes), "shard").withColumn("lane", F.pmod(F.xxhash64("query_id"), F.col("lanes")).cast("int")).drop("lanes")
    left = blocks.join(F.broadcast(lanes), "shard").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")

    def both(own: pa.Table, ask: pa.Table) -> pa.Table:
        return pa.Table.from_batches([answer(own.to_pylist()[0], columns(ask))]) if own.num_rows and ask.num_rows else nothing

    kinds = spark.createDataFrame([], schema).toArrow().schema
    nothing = kinds.empty_table()
    return left.groupBy("shard", "lane").cogroup(visits.groupBy("shard", "lane")).applyInArrow(both, schema)


def knn(shards: Shards, queries: DataFrame, k: int, ef: int = 10, **more: Any) -> DataFrame:
    """The ``k`` nearest by :func:`search`, with a beam of ``ef`` or ``k`` if that is more."""
    return search(shards, queries, TopK(k), max(ef, k), **more)


def fitted(shards: Shards, base: DataFrame, policy: Policy, ef: int, hidden: DataFrame | None = None, where: Column | None = None, goal: float = GOAL) -> tuple[int, int]:
    """``(probes, ef)`` by which a search reaches a recall of ``goal``, measured against the exact answer.

    The queries of the trial are TRIALS vectors of ``base``, which is read
    once for their answers.  Where these lie tells how many shards have to be
    visited; if that is not enough, more are, and then the beam is widened.
    Fewer than the default or narrower than ``ef`` is not tried.
    """
    held, probes = len(shards.held), shards.probes(None)
    rows = base.where(~F.col("deleted")).where(distances.finite("vector"))
    asked = stored(rows.orderBy(F.xxhash64("label"), "label").limit(TRIALS).select(F.col("label").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "trials")
    truth = stored(exact.search(base, asked, shards.params.space, policy, where).select("query_id", "label"), "truth")
    lie = members(shards).join(truth, "label").groupBy("query_id", "shard").count().toPandas()
    if not len(lie):
        return probes, ef
    sent = asked.toArrow()
    x = matrix(sent.column("vector"), None)
    g = shards.router
    away = distances.block(g.space, distances.unit(x) if shards.params.space == "cosine" else x, g.x)
    place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)  # how many shards are visited before each
    row = {q: i for i, q in enumerate(sent.column("query_id").to_pylist())}
    rank = np.array([place[row[q], np.searchsorted(shards.held, s)] for q, s in zip(lie["query_id"], lie["shard"], strict=True)])
    order = np.argsort(rank)
    covered = np.cumsum(lie["count"].to_numpy()[order])
    probes = max(probes, int(rank[order][np.searchsorted(covered, (1 + goal) / 2 * covered[-1])]) + 1)
    while exact.recall(search(shards, asked, policy, ef, probes, hidden), truth).first()["recall"] < goal:
        if probes < held:
            probes = min(held, math.ceil(probes * 1.2))
        elif ef < 2 * shards.params.shard_rows:
            ef *= 2
        else:
            break
    return probes, ef


def _routed(asked: DataFrame, shards: Shards, probes: int) -> DataFrame:
    """``asked`` with the ``shards`` that each query visits."""
    params = shards.params
    sent = asked.sparkSession.sparkContext.broadcast((shards.router, shards.held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = sent.value
        for b in batches:
            x = matrix(b.column("vector"), g.x.shape[1])
            to = held[_route(g, x, probes, params.space)] if len(x) else np.zeros((0, 0), np.int64)
            ends = np.arange(len(x) + 1) * (to.shape[1] if len(x) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(to.ravel().astype(np.int32)))], [*b.schema.names, "shards"])

    return asked.mapInArrow(run, "query_id long, vector array<double>, shards array<int>")


def _barred(blocks: DataFrame, shards: Shards, hidden: DataFrame | None) -> tuple[DataFrame, Any]:
    """The blocks and the sorted labels that a search hides: few are sent to all tasks, many join the blocks by shard."""
    if hidden is None:
        return blocks, None
    hidden = stored(hidden.select("label"), "hidden")
    count = hidden.count()
    if not count:
        return blocks, None
    if count <= SENT_LABELS:
        return blocks, blocks.sparkSession.sparkContext.broadcast(np.sort(hidden.toArrow().column("label").to_numpy()))
    lists = members(shards).join(hidden, "label").groupBy("shard").agg(F.collect_list("label").alias("hidden"))
    return blocks.join(lists, "shard", "left"), None


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def save(store: Store, shards: Shards) -> dict[str, Any]:
    """``shards`` as part of a manifest; a space of one's own has no name and cannot be saved."""
    p = shards.params
    if not isinstance(p.space, str):
        raise ValueError("a distance of one's own cannot be saved")
    table = shards.blocks.base.rows.sparkSession.createDataFrame(pa.table({"shard": pa.array(range(len(shards.centres)), pa.int32()), "centre": pa.array(list(shards.centres), pa.list_(pa.float64()))}))
    return {"blocks": store.save(shards.blocks), "centres": {"folder": store.write(table), "count": len(shards.centres)}, "params": {"space": p.space, "links": p.links, "ef_construction": p.ef_construction, "seed": p.seed, "shard_rows": p.shard_rows}}


def load(store: Store, part: dict[str, Any]) -> Shards:
    got = store.table(part["centres"]["folder"]).orderBy("shard").toArrow()
    return Shards(store.load(part["blocks"]), matrix(got.column("centre"), None), Params(**part["params"]))
