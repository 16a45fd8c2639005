"""Exact nearest-neighbour search as a Spark plan.

Queries of a checked size travel to the tasks that scan the base table: each
task keeps a prefix per query, so the base is read once, in place, and only
prefixes are shuffled.  For more queries than that the base is cut in blocks,
and batches of queries pass by each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators.policies import Policy, Radius, TopK
from nearloom.session import ship

#: Queries that may be sent to every task, by number and by components in all; more are searched in pieces.
SENT_QUERIES, SENT_VALUES = 20_000, 16_000_000
#: Rows of the base and queries that a task holds in a search by pieces.
BLOCK, BATCH = 16_384, 2_048

FOUND = "query_id long, label long, doc_id long, distance double"


def vectors(df: DataFrame, label: str | Column = "label", vector: str | Column = "vector", doc_id: str | Column | None = None, deleted: str | Column | None = None) -> DataFrame:
    """``(label, vector, doc_id, deleted)`` from any table."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_column(label).cast("long").alias("label"),
        as_column(vector).alias("vector"),
        (F.lit(None) if doc_id is None else as_column(doc_id)).cast("long").alias("doc_id"),
        (F.lit(False) if deleted is None else as_column(deleted)).alias("deleted"),
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None) -> np.ndarray:
    """Rows of equal length as a matrix of doubles; an error for nulls and other lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector is null")
    sizes = np.asarray(pa.compute.list_value_length(column))
    if len(sizes) and (sizes != (sizes[0] if dim is None else dim)).any():
        raise ValueError("Wrong dimensionality of the vectors")
    values = column.flatten()
    if values.null_count:
        raise ValueError("a vector holds a null")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(sizes) else dim or 0)


class _Kept:
    """The best of one query so far in one task."""

    __slots__ = ("label", "doc", "distance")

    def __init__(self) -> None:
        self.label = self.doc = np.zeros(0, np.int64)
        self.distance = np.zeros(0)

    def add(self, label: np.ndarray, doc: np.ndarray, distance: np.ndarray, policy: Policy) -> None:
        if not len(label):
            return
        label, doc, distance = np.concatenate([self.label, label]), np.concatenate([self.doc, doc]), np.concatenate([self.distance, distance])
        order = np.lexsort((label, distance))
        order = order[: policy.prefix(distance[order], doc[order])]
        self.label, self.doc, self.distance = label[order], doc[order], distance[order]

    def bound(self, policy: Policy) -> float:
        """The distance beyond which no row can be of use to the answer."""
        keys, few = policy.groups(self.doc)
        if few is None or len(self.label) < few or (keys is not None and len(np.unique(keys)) < few):
            return np.inf
        return self.distance[-1 if keys is not None else few - 1] if few else -np.inf


#: Rough distances that a scan holds at a time, so that they stay in a core's cache, and groups of rows per row of the shortlist.
ROUGH, GROUPS = 1 << 19, 16
#: Components of rows for which a distance's bounds are made at a time.
BOUNDED = 1 << 21


def _scan(kept: list[_Kept], queries: np.ndarray, label: np.ndarray, doc: np.ndarray, base: np.ndarray, space: str, policy: Policy, radius: float | np.ndarray | None) -> None:
    """Add to each query's best what ``base`` has; rows with a component that is not finite have no distance and are left out.

    The nearest of each of many groups of rows bound what an answer can hold,
    for some queries at once; only rows within the bound are asked exactly.
    ``radius``, one for all or of each query, bounds them from the beginning.
    """
    whole = np.isfinite(base).all(axis=1)
    if not whole.all():
        label, doc, base = label[whole], doc[whole], base[whole]
    if not len(label) or not len(queries):
        return
    own = isinstance(space, distances.Distance)
    sure = own and space.below is not None
    if sure and base.size > BOUNDED and len(label) > 1:  # what bounds the rows is larger than they are
        half = len(label) // 2
        for part in (slice(half), slice(half, None)):
            _scan(kept, queries, label[part], doc[part], base[part], space, policy, radius)
        return
    keys, few = policy.groups(doc)
    if few is None:
        starts = None
    elif keys is None:
        starts = np.arange(0, len(label), max(1, len(label) // (GROUPS * max(few, 4))))
    else:
        order = np.argsort(keys, kind="stable")
        label, doc, base, keys = label[order], doc[order], base[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    with np.errstate(over="ignore", invalid="ignore"):
        # What rounding may be off by: for each row by its own size, so that a long vector does not blur the others.
        # A product of single precision is good to 64 * 2**-24 of the sizes for 64 components; what it cannot hold is asked exactly.
        unsure = max(1e-5, 2e-7 * base.shape[1])
        spare = (unsure * (base * base).sum(axis=1) + (unsure if space == "cosine" else 1e-9)).astype(np.float32)
        more = np.zeros(len(queries)) if own else unsure * (queries * queries).sum(axis=1)
        rough, asked = (base, queries) if own else (base.astype(np.float32), queries.astype(np.float32))
        below = _bounds(space, base) if sure else None
    step = max(1, (4 if sure else 1) * ROUGH // len(label))  # a product of many terms is the faster the more queries it has
    for i in range(0, len(queries), step):
        part, own_more = queries[i : i + step], more[i : i + step]
        bound = np.full(len(part), np.inf if radius is None else radius[i : i + step] if isinstance(radius, np.ndarray) else radius)
        with np.errstate(over="ignore", invalid="ignore"):
            low = below(part) if sure else distances.block(space, asked[i : i + step], rough)
            slack = low.dtype.type(0) if sure else 1e-9 * (1 + np.abs(low)) if own else spare
            if few == 0:
                bound[:] = -np.inf
            elif few is not None:
                if few <= len(starts) and sure:
                    bound = np.fmin(bound, _reached(space, part, base, keys, low, starts, few))
                elif few <= len(starts):
                    high = np.minimum.reduceat(low + slack, starts, axis=1)
                    bound = np.fmin(bound, np.partition(high, few - 1, axis=1)[:, few - 1] + own_more)  # what overflows bounds nothing
                bound = np.minimum(bound, [k.bound(policy) for k in kept[i : i + step]])
            low -= slack
            bound += own_more
            bound = np.nextafter(bound.astype(low.dtype), low.dtype.type(np.inf))
            far = np.greater(low, bound[:, None])
        at, row = np.divmod(np.flatnonzero(~far), len(label))  # what overflows is asked exactly
        away = distances.pairs(space, part, base, at, row)
        order = np.lexsort((label[row], away, at))
        at, row, away = at[order], row[order], away[order]
        ends = np.searchsorted(at, np.arange(len(part) + 1))
        for q in np.flatnonzero(np.diff(ends)).tolist():
            mine = slice(ends[q], ends[q + 1])
            kept[i + q].add(label[row[mine]], doc[row[mine]], away[mine], policy)


_last: list = []


def _bounds(space: distances.Distance, base: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``space.below`` of ``base``, made once while batches of queries pass by the same rows."""
    if not _last or _last[0] is not space or _last[1] is not base:
        _last[:] = space, base, space.below(base)
    return _last[2]


def _reached(space: distances.Distance, queries: np.ndarray, base: np.ndarray, keys: np.ndarray | None, low: np.ndarray, starts: np.ndarray, few: int) -> np.ndarray:
    """For each query the ``few``-th nearest of the groups, if only some rows count whose bounds ``low`` are least; infinite if these are fewer."""
    most = min(4 * few, len(starts)) - 1
    least = np.partition(np.minimum.reduceat(low, starts, axis=1), most, axis=1)[:, most]
    at, row = np.divmod(np.flatnonzero(low <= least[:, None]), len(base))
    away, key = distances.pairs(space, queries, base, at, row), row if keys is None else keys[row]
    order = np.lexsort((away, key, at))
    at, key, away = at[order], key[order], away[order]
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0))  # the nearest of each group
    at, away = at[first], away[first]
    order = np.lexsort((away, at))
    ends = np.searchsorted(at, np.arange(len(queries) + 1))
    out = np.full(len(queries), np.inf)
    full = np.flatnonzero(np.diff(ends) >= few)
    out[full] = away[order][ends[full] + few - 1]
    return out


def _rows(ids: np.ndarray, kept: list[_Kept]) -> pa.RecordBatch:
    sizes = [len(k.label) for k in kept]
    join = lambda xs, t: np.concatenate([np.zeros(0, t), *xs])
    doc = join([k.doc for k in kept], np.int64)
    columns = [np.repeat(ids, sizes), join([k.label for k in kept], np.int64), pa.array(doc, mask=doc == _NO_DOC), join([k.distance for k in kept], np.float64)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["query_id", "label", "doc_id", "distance"])


_NO_DOC = np.iinfo(np.int64).min


def _docs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pa.compute.fill_null(column, _NO_DOC).to_numpy(**({} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False}))


def search(base: DataFrame, queries: DataFrame, space: str | Callable[[Column, Column], Column], policy: Policy, where: Column | None = None, metrics: Observation | None = None) -> DataFrame:
    """Answers ``(query_id, rank, label, doc_id, distance)`` of ``queries (query_id, vector)`` over ``base`` (:func:`vectors`).

    Deleted rows and those that ``where`` (a condition on ``base``) excludes
    are left out before anything is compared.  Ties go to the smaller label.
    ``space`` is a name of :data:`distances.SPACES` or a function from two
    vector columns to a distance column.  Null vectors and vectors of another
    length raise; vectors with a component that is not finite have no distance:
    they are left out, and as queries get no rows.  Fewer rows than asked for
    are returned as they are; an empty base or no queries give no rows.  ``metrics`` gets ``candidates``,
    the rows that each query is compared with, once the answer is computed.
    """
    live = base.where(~F.col("deleted"))
    if where is not None:
        live = live.where(where)
    if metrics is not None:
        live = live.observe(metrics, F.count(F.lit(1)).alias("candidates"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where(distances.finite("vector"))
    # Counted before anything is fetched: few vectors may be long ones.
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    small = size[0] <= SENT_QUERIES and size[1] <= SENT_VALUES
    if callable(space) and not isinstance(space, distances.Distance):
        found = _by_column(live.where(distances.finite("vector")), asked, space, size[0], small and size[0] <= BATCH)
        return policy.choose(found).select("query_id", "rank", "label", "doc_id", "distance")
    distances.check_space(space)
    ship(base.sparkSession)
    radius = policy.epsilon if isinstance(policy, Radius) else None
    found = _by_scan(live, asked.toArrow(), space, policy, radius) if small else _by_pieces(live, asked, space, policy, radius)
    return policy.choose(found).select("query_id", "rank", "label", "doc_id", "distance")


def _by_scan(live: DataFrame, sent: pa.Table, space: str, policy: Policy, radius: float | None) -> DataFrame:
    ids = sent.column("query_id").to_numpy()
    whole = isinstance(policy, Radius) and policy.most is None
    asked = live.sparkSession.sparkContext.broadcast((ids, matrix(sent.column("vector"), None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = asked.value
        kept = [_Kept() for _ in ids]
        for b in batches:
            if b.num_rows and len(ids):
                _scan(kept, queries, b.column(0).to_numpy(), _docs(b.column(2)), matrix(b.column(1), queries.shape[1]), space, policy, radius)
            if whole:  # a row is an answer whatever the others are: nothing is held
                yield _rows(ids, kept)
                kept = [_Kept() for _ in ids]
        yield _rows(ids, kept)

    return live.select("label", "vector", "doc_id").mapInArrow(run, FOUND)


#: Queries that pass by a block in one task: the block is copied once per so many; and pieces per core, about.
LANE, PIECES = 65_536, 2


def _by_pieces(live: DataFrame, asked: DataFrame, space: str, policy: Policy, radius: float | None) -> DataFrame:
    """A task takes in a block of the base and then lets batches of queries pass by; it holds one of each."""
    held, count = live.count(), asked.count()
    blocks, lanes = max(1, -(-held // BLOCK)), max(1, -(-count // LANE))
    # A few pieces for each core, so that none waits for the last one.
    lanes = max(lanes, min(-(-PIECES * live.sparkSession.sparkContext.defaultParallelism // blocks), count // BATCH))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("long")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = live.select(dealt("label", blocks).alias("b"), every(lanes).alias("s"), F.lit(0).alias("ask"), F.col("label").alias("id"), "vector", "doc_id")
    right = asked.select(every(blocks).alias("b"), dealt("query_id", lanes).alias("s"), F.lit(1).alias("ask"), F.col("query_id").alias("id"), "vector", none.alias("doc_id"))
    both = left.withColumn("vector", F.col("vector").cast("array<double>")).unionByName(right.withColumn("vector", F.col("vector").cast("array<double>")))
    # Each piece has a partition of its own: by hashes some tasks would have several and others none.
    both = both.repartitionById(blocks * lanes, F.col("b") * lanes + F.col("s")).sortWithinPartitions("b", "s", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ask: list[tuple[np.ndarray, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            if ask and own:
                label, doc, base = (np.concatenate(x) for x in zip(*own, strict=True))
                own[:] = [(label, doc, base)]
                ids, queries = (np.concatenate(x) for x in zip(*ask, strict=True))
                for i in range(0, len(ids), BATCH):
                    kept = [_Kept() for _ in ids[i : i + BATCH]]
                    _scan(kept, queries[i : i + BATCH], label, doc, base, space, policy, radius)
                    yield _rows(ids[i : i + BATCH], kept)
            ask.clear()

        for whole in batches:
            keys = np.stack([whole.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                b, key = whole.slice(i, j - i), (int(keys[i][0]), int(keys[i][1]))
                if key != at:
                    yield from answer()
                    own.clear()
                    at = key
                if keys[i][2] == 0:
                    own.append((b.column(3).to_numpy(), _docs(b.column(5)), matrix(b.column(4), own[0][2].shape[1] if own else None)))
                else:
                    ask.append((b.column(3).to_numpy(), matrix(b.column(4), own[0][2].shape[1] if own else None)))
                    if sum(len(x[0]) for x in ask) >= BATCH:
                        yield from answer()
        yield from answer()

    return both.mapInArrow(run, FOUND)


def _by_column(live: DataFrame, asked: DataFrame, distance: Callable[[Column, Column], Column], count: int, small: bool) -> DataFrame:
    """Pairs of pieces joined on the pieces' numbers, with the distance as an expression; one checked batch is broadcast."""
    batches = max(1, -(-count // BATCH))
    ask = asked.select("query_id", F.col("vector").alias("_q"), F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int").alias("s"))
    rows = live.select("label", "doc_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("s"))
    found = rows.join(F.broadcast(ask) if small else ask, "s")
    return found.select("query_id", "label", "doc_id", distance(F.col("_q"), F.col("vector")).cast("double").alias("distance"))


def enough(base: DataFrame, k: int, where: Column | None = None) -> None:
    """Raise if there are fewer than ``k`` rows that a query may find; it is the same for every query."""
    live = base.where(~F.col("deleted")).where(distances.finite("vector"))
    if (live if where is None else live.where(where)).limit(k).count() < k:
        raise RuntimeError("Cannot return the results in a contiguous 2D array: some queries have fewer than k neighbours")


def knn(base: DataFrame, queries: DataFrame, k: int = 1, space: str | Callable[[Column, Column], Column] = "l2", where: Column | None = None, strict: bool = False) -> DataFrame:
    """The ``k`` nearest of each query; with ``strict`` it raises if any query would have fewer."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if strict:
        enough(base, k, where)
    return search(base, queries, space, TopK(k), where)


def wide(found: DataFrame) -> DataFrame:
    """One row per query: ``(query_id, labels, distances)``, nearest first."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "label", "distance")))
    return found.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.col("r.label").alias("labels"), F.col("r.distance").alias("distances"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(matched, total, recall)``: how many of the true ``(query_id, label)`` were found."""
    hit = found.select("query_id", "label", F.lit(1).alias("hit")).distinct()
    both = truth.select("query_id", "label").join(hit, ["query_id", "label"], "left")
    return both.agg(F.count("hit").alias("matched"), F.count("*").alias("total"), (F.count("hit") / F.count("*")).alias("recall"))
