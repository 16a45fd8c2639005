"""Index maintenance and search on streams.

A stream of mutations becomes versions of a table, one per micro-batch and of
its number, so a batch that runs twice is committed once; each writes the rows
that it changes.  Queries on a stream are answered per micro-batch against a
snapshot, since ranking needs a whole batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearloom.operators.codecs.bits import BitWriter
from nearloom.operators.codecs.bulk import carried
from nearloom.operators.codecs.registry import encoder
from nearloom.operators.search import knn
from nearloom.operators.snapshots import GONE, Conflict, Layer, Layered, Store, small
from nearloom.session import ship
from nearloom.shared import stored

#: Values of a series that are sized at a time.
CHUNK = 65_536
#: Groups of series, each with one state.
GROUPS = 512

STATE = "label long, vector array<double>, deleted boolean, seq long"


def read_version(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The state after micro-batch ``batch``; empty before the first."""
    return _state(Store(spark, path), batch).rows


def _state(store: Store, batch: int) -> Layered:
    """The table of the last version up to ``batch``."""
    number = max((n for n in store.versions() if n <= batch), default=None)
    table = Layered("label", Layer(store.spark.createDataFrame([], STATE), 0)) if number is None else store.load(store.read(number)["state"])
    return replace(table, store=store)


def apply_log(state: DataFrame, log: DataFrame) -> DataFrame:
    """``state`` after ``log (seq, op, label, vector)``; see :func:`nearloom.operators.mutations.from_log`."""
    last = log.groupBy("label").agg(
        F.max_by("vector", F.when(F.col("op") == "add", F.col("seq"))).alias("_v"), F.max_by("op", "seq").alias("_op"), F.max("seq").alias("_seq"), F.count_if(F.col("op") == "add").alias("_adds")
    )
    both = state.join(last, "label", "full")
    both = both.select(
        "label", F.when(F.col("_adds") > 0, F.col("_v")).otherwise(F.col("vector")).alias("vector"),
        F.when(F.col("_op").isNotNull(), F.col("_op") == "delete").otherwise(F.col("deleted")).alias("deleted"), F.greatest("seq", "_seq").alias("seq"),
    )
    return both.where(F.col("vector").isNotNull())


def apply_batch(log: DataFrame, path: str, number: int) -> None:
    """Commit micro-batch ``number`` of mutations as a version of that number below ``path``.

    It writes the rows of the labels that the batch names, and now and then
    folds what has gathered.  A batch that runs again, after a failure, finds
    its version committed and changes nothing.
    """
    store = Store(log.sparkSession, path)
    if number in store.versions():
        return
    before = _state(store, number - 1)
    log = stored(log.select("seq", "op", "label", "vector"), "log")
    labels = log.select("label").distinct()
    touched = before.rows.join(small(labels, log.count()), "label", "left_semi") if before.base.count or before.deltas else before.rows
    try:
        store.commit(number, {"state": store.save(before.changed(apply_log(touched, log).withColumn(GONE, F.lit(False))))})
    except Conflict:  # another run of the same batch was first, and did the same
        pass


def maintain(log: DataFrame, path: str) -> DataStreamWriter:
    """A writer that turns a stream of mutations into versions below ``path``; start it with a checkpoint location.

    Old versions stay until :meth:`nearloom.operators.snapshots.Store.expire`.
    """
    return log.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, path, number)).outputMode("append")


def answer(queries: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], space: str = "l2") -> DataStreamWriter:
    """A writer that hands the answers of each micro-batch of ``queries`` over ``base`` to ``sink``."""

    def step(batch: DataFrame, number: int) -> None:
        sink(knn(base, batch, k, space), number)

    return queries.writeStream.foreachBatch(step).outputMode("append")


def deduplicated(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream without rows that repeat ``keys`` within ``delay`` of each other by the column ``time``; state is dropped behind the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def codec_sizes(series: DataFrame, algorithm: str, config: dict[str, int] | None = None) -> DataFrame:
    """Running sizes of a stream ``(series_id, pos, value)`` under a codec: ``(series_id, n_values, n_bits)`` as batches come.

    The state of a series is its encoder's; the rows of a series in one
    micro-batch are coded in order of ``pos``, in arrays where these tell all
    (:func:`nearloom.operators.codecs.bulk.carried`).  Series share the state
    of a group, so that many short ones do not cost a call each.
    """
    names = sorted(vars(encoder(algorithm, config)))  # unknown names and parameters raise here
    ship(series.sparkSession)

    def step(key: tuple, batches, state: GroupState):
        known = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat([b[["series_id", "pos", "value"]] for b in batches]).sort_values("pos", kind="stable")
        found = []
        for sid, own in rows.groupby("series_id", sort=False, dropna=False)["value"]:
            sid = sid if isinstance(sid, str) else None
            code, values = encoder(algorithm, config), own.to_numpy(float)
            n, bits, kept = known.get(sid, (0, 0, ()))
            vars(code).update(zip(names, kept, strict=False))
            for start in range(0, len(values), CHUNK):
                code, more = carried(code, values[start : start + CHUNK], algorithm, config)
                bits += more
            known[sid] = n + len(values), bits, tuple(vars(code)[k] for k in names)
            found.append((sid, *known[sid][:2]))
        state.update((pickle.dumps(known),))
        yield pd.DataFrame(found, columns=["series_id", "n_values", "n_bits"])

    dealt = series.select(F.col("series_id").cast("string").alias("series_id"), "pos", "value").withColumn("group", F.pmod(F.xxhash64("series_id"), F.lit(GROUPS)).cast("int"))
    return dealt.groupBy("group").applyInPandasWithState(step, "series_id string, n_values long, n_bits long", "series binary", "update", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """A series' encoder, and its rows that the watermark has not passed yet."""

    def __init__(self, algorithm: str, config: dict[str, int] | None, idle: int | None):
        self.algorithm, self.config, self.idle = algorithm, config, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coder = handle.getValueState("coder", "code binary, n long, bits long, last long")
        self.waiting = handle.getListState("waiting", "ms long, pos long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["value"].notna()]
        if len(new):
            self.waiting.appendList([(int(ms), int(pos), float(v)) for ms, pos, v in zip(new["millis"], new["pos"], new["value"], strict=True)])
            self.handle.registerTimer(int(new["millis"].max()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, left = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        code, n, bits, last = self.coder.get() if self.coder.exists() else (None, 0, 0, 0)
        state = pickle.loads(code) if code else encoder(self.algorithm, self.config)
        size = lambda closed: pd.DataFrame({"series_id": [key[0]], "n_values": [n], "n_bits": [bits], "closed": [closed]})
        idle = lambda now: self.idle is not None and n > 0 and now > last + self.idle
        for ms, _, value in ready:
            if idle(ms):
                yield size(True)
                state, n, bits = encoder(self.algorithm, self.config), 0, 0
            out = BitWriter()
            state.encode(value, out)
            n, bits, last = n + 1, bits + out.n_bits, ms
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        if idle(passed):
            yield size(True)
            self.coder.clear()
        elif ready:
            self.coder.update((pickle.dumps(state), n, bits, last))
            if self.idle is not None:
                self.handle.registerTimer(last + self.idle + 1)
            yield size(False)

    def close(self) -> None:
        pass


def codec_sizes_in_order(series: DataFrame, algorithm: str, config: dict[str, int] | None = None, time: str = "ts", delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """Running sizes of a stream ``(series_id, pos, value, <time>)`` under a codec, coded in order of time: ``(series_id, n_values, n_bits, closed)``.

    Rows wait in state until the watermark, ``delay`` behind the latest time
    seen, has passed them; then they are coded in order of time and ``pos``, so
    rows that come out of order give the sizes of ordered ones.  Rows behind
    the watermark are dropped.  A series without rows for ``idle`` is closed
    with a last row, and its state is dropped.  Rows without a value count
    nothing.  The session's state store must be RocksDB.
    """
    encoder(algorithm, config)  # unknown names and parameters raise here
    ship(series.sparkSession)
    pause = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = series.select("series_id", "pos", F.col("value").cast("double").alias("value"), F.col(time).alias("event_time"), F.unix_millis(time).alias("millis")).withWatermark("event_time", delay)
    return rows.groupBy("series_id").transformWithStateInPandas(
        _InOrder(algorithm, config, pause), "series_id string, n_values long, n_bits long, closed boolean", "Update", "EventTime"
    )
