"""Codecs over tables of ordered series ``(series_id, pos, value)``.

A series is sequential, but it is never gathered.  A long one is cut in
segments by position, which are coded side by side: the coder of a segment is
led up to it by the rows before its cut.  The states at both sides of every cut
are then compared, and a segment that began in another state than the one
before it ended in is coded again from that.  So each value takes the bits that
it takes of one coder that goes through the whole series (where a coder has a
ring of values, a block counts its places from the oldest).  Each block states
the state that it begins in, so all are decoded side by side, too.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from nearloom.operators.codecs.bits import BitReader, BitWriter
from nearloom.operators.codecs.registry import decoder, encoder, stated
from nearloom.session import ship
from nearloom.shared import stored

#: Bits of a block of a compressed series; a longer series has several.
BLOCK_BITS = 8 << 23

#: Values of a segment, about; the share of a long series' positions that its cuts are chosen from; and those of them that lead up to a cut.
SEGMENT, SAMPLED, LEAD = 65_536, 64, 32
#: How often segments are coded again side by side; what then is left of a series is coded in one go.
ROUNDS = 3

BLOCKS = "series_id string, segment int, block int, first_pos long, n_values long, n_bits long, state string, ended string, data binary"
_KEYED = "series_id string, segment int, warm boolean, pos long, value double"

#: By series the positions of its cuts and those from which rows lead up to them.
Cuts = dict[str, tuple[np.ndarray, np.ndarray]]


def restored(coder: Any, state: str | None) -> Any:
    vars(coder).update(ast.literal_eval(state or "[]"))
    return coder


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition("series_id").sortWithinPartitions("series_id", *by)


def _rows(series: DataFrame) -> DataFrame:
    return series.select(F.col("series_id").cast("string"), F.col("pos").cast("long"), F.col("value").cast("double")).where("series_id IS NOT NULL AND value IS NOT NULL")


def _cuts(rows: DataFrame) -> tuple[Cuts, int]:
    """Where long series are cut, by the hashes of their positions, and the rows in all."""
    step = max(1, SEGMENT // SAMPLED)
    picked = F.array_sort(F.collect_list(F.when(F.pmod(F.xxhash64("pos"), F.lit(SAMPLED)) == 0, F.col("pos"))))
    seen = Observation()
    found = rows.groupBy("series_id").agg(F.count("*").alias("n"), picked.alias("picked")).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    at = F.sequence(F.lit(step), F.size("picked") - 1, F.lit(step))
    # Both are made before they are fetched: a long series has a cut for each segment.
    long = found.where((F.col("n") > SEGMENT) & (F.size("picked") > step)).select("series_id", F.transform(at, lambda i: F.get("picked", i)).alias("cuts"), F.transform(at, lambda i: F.get("picked", F.greatest(i - LEAD, F.lit(0)))).alias("leads"))
    cuts = {}
    for sid, at_, leads in long.collect():
        own, first = np.unique(np.array(at_, np.int64), return_index=True)
        cuts[sid] = own, np.array(leads, np.int64)[first]
    return cuts, int(seen.get["total"])


def _keyed(rows: DataFrame, cuts: Cuts, tasks: int, again: dict[tuple[str, int], tuple[int, str]]) -> DataFrame:
    """Rows with their segments, and once more, ``warm``, those that lead up to the next; or, if any are coded ``again``, the rows of these."""
    redone: dict[str, list[tuple[int, int]]] = {}
    for (sid, segment), (until, _) in sorted(again.items()):
        redone.setdefault(sid, []).append((segment, until))
    sent = rows.sparkSession.sparkContext.broadcast((cuts, redone))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, redone = sent.value
        for b in batches:
            names = b.column(0).dictionary_encode()
            code, pos = names.indices.to_numpy(), pa.compute.fill_null(b.column(1), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            segment, taken, warm = np.zeros(len(pos), np.int32), np.full(len(pos), not redone), [np.zeros(0, int)]
            for i, sid in enumerate(names.dictionary.to_pylist()):
                mine = np.flatnonzero(code == i) if sid in cuts else None
                if mine is None:
                    continue
                own, leads = cuts[sid]
                at = np.searchsorted(own, pos[mine], side="right")
                segment[mine] = at
                if not redone:
                    near = at < len(own)
                    near[near] = pos[mine[near]] >= leads[at[near]]
                    warm.append(mine[near])
                for first, until in redone.get(sid, ()):
                    inside = mine[(at >= first) & (at <= until)]
                    segment[inside], taken[inside] = first, True
            keep, more = np.flatnonzero(taken), np.concatenate(warm)
            index = pa.array(np.concatenate([keep, more]))
            of = pa.array(np.concatenate([segment[keep], segment[more] + 1]).astype(np.int32))
            flag = pa.array(np.arange(len(index)) >= len(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), of, flag, b.column(1).take(index), b.column(2).take(index)], ["series_id", "segment", "warm", "pos", "value"])

    return rows.mapInArrow(deal, _KEYED).repartition(tasks, "series_id", "segment").sortWithinPartitions("series_id", "segment", F.col("warm").desc(), "pos", "value")


def _coded(rows: DataFrame, cuts: Cuts, total: int, algorithm: str, config: dict[str, int] | str | None, block_bits: int, again: dict[tuple[str, int], tuple[int, str]]) -> DataFrame:
    """Blocks of all segments, or of those that begin ``again`` in a given state."""
    tasks = min(20_000, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // (2 * SEGMENT))))
    begin = rows.sparkSession.sparkContext.broadcast({k: state for k, (_, state) in again.items()})
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        out, done = BitWriter(), []
        block = n = first = 0
        start = ""

        def close() -> None:
            data, bits = out.take()
            done.append((*now, block, first, n, bits, start, stated(state), data))

        for b in batches:
            for sid, segment, warm, pos, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (sid, segment) != now:
                    if n:
                        close()
                    now, block, n = (sid, segment), 0, 0
                    state = restored(encoder(algorithm, config), begin.value.get(now))
                elif out.n_bits >= block_bits and n:
                    close()
                    block, n = block + 1, 0
                if warm:
                    state.encode(value, BitWriter())
                    continue
                if not n:
                    first, start = pos, stated(state)
                    restored(state, start)
                state.encode(value, out)
                n += 1
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=_SCHEMA)
                done.clear()
        if n:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=_SCHEMA)

    return stored(_keyed(rows, cuts, tasks, again).mapInArrow(run, BLOCKS), "series")


def compress(series: DataFrame, algorithm: str, config: dict[str, int] | str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Blocks (BLOCKS) of each series, in order of ``segment`` and ``block``, which is that of ``pos``.

    Rows without a value or a series are left out; rows that share a position
    are coded in order of their values.  An empty table gives no rows.
    """
    fresh = stated(encoder(algorithm, config))  # unknown names and parameters raise here
    ship(series.sparkSession)
    rows = _rows(series)
    cuts, total = _cuts(rows)
    blocks = _coded(rows, cuts, total, algorithm, config, block_bits, {})
    before = F.lag("ended", 1, fresh).over(Window.partitionBy("series_id").orderBy("segment", "block"))
    done = 0
    while cuts:
        seams = blocks.where(F.col("series_id").isin(list(cuts))) if len(cuts) <= 1000 else blocks
        wrong = seams.withColumn("before", before).where("state <> before").select("series_id", "segment", "before").orderBy("series_id", "segment").collect()
        if not wrong:
            break
        again: dict[tuple[str, int], tuple[int, str]] = {}
        for sid, segment, state in wrong:
            if done < ROUNDS:
                again[sid, segment] = segment, state
            elif not any(k[0] == sid for k in again):  # all before the first is right, and what follows is coded from there
                again[sid, segment] = len(cuts[sid][0]), state
        gone = series.sparkSession.createDataFrame([(*k, until) for k, (until, _) in again.items()], "series_id string, first int, until int")
        match = (blocks["series_id"] == gone["series_id"]) & blocks["segment"].between(gone["first"], gone["until"])
        kept = blocks.join(F.broadcast(gone), match, "left_anti")
        blocks = stored(kept.unionByName(_coded(rows, cuts, total, algorithm, config, block_bits, again)), "series")
        done += 1
    return blocks


_SCHEMA = pa.schema(
    [("series_id", pa.string()), ("segment", pa.int32()), ("block", pa.int32()), ("first_pos", pa.int64()), ("n_values", pa.int64()), ("n_bits", pa.int64()), ("state", pa.string()), ("ended", pa.string()), ("data", pa.binary())]
)


def decompress(blocks: DataFrame, algorithm: str, config: dict[str, int] | str | None = None) -> DataFrame:
    """``(series_id, idx, value)`` of blocks that :func:`compress` made; ``idx`` counts from 0 in each series."""
    decoder(algorithm, config)
    ship(blocks.sparkSession)
    key = ["series_id", "segment", "block"]
    before = Window.partitionBy("series_id").orderBy("segment", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select(*key, F.coalesce(F.sum("n_values").over(before), F.lit(0)).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sid, at, n, bits, state, data = (b.column(c)[i].as_py() for c in ("series_id", "at", "n_values", "n_bits", "state", "data"))
                coder, reader = restored(decoder(algorithm, config), state), BitReader(data, bits)
                for start in range(at, at + n, 65_536):
                    values = [coder.decode(reader) for _ in range(min(65_536, at + n - start))]
                    yield pa.RecordBatch.from_arrays([pa.array([sid] * len(values), pa.string()), pa.array(np.arange(start, start + len(values))), pa.array(values, pa.float64())], ["series_id", "idx", "value"])

    dealt = blocks.join(first, key).select("series_id", "at", "n_values", "n_bits", "state", "data")
    tasks = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    return dealt.repartition(tasks, "series_id", "at").mapInArrow(run, "series_id string, idx long, value double")


def total_bits(series: DataFrame, algorithms: dict[str, tuple[str, dict[str, int] | None]]) -> DataFrame:
    """``(algorithm, n_values, n_bits)`` over all series, for each ``{name: (codec, config)}``; rows are sorted once, for all of them."""
    for codec, config in algorithms.values():
        encoder(codec, config)
    ship(series.sparkSession)
    rows = series.select(F.col("series_id").cast("string"), F.col("pos").cast("long"), F.col("value").cast("double")).where("series_id IS NOT NULL AND value IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, coders, n = None, {}, 0
        bits = dict.fromkeys(algorithms, 0)
        for b in batches:
            for sid, value in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if sid != now:
                    now, coders = sid, {k: encoder(*v) for k, v in algorithms.items()}
                n += 1
                for k, coder in coders.items():
                    out = BitWriter()
                    coder.encode(value, out)
                    bits[k] += out.n_bits
        names = list(algorithms)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n] * len(names), pa.int64()), pa.array([bits[k] for k in names], pa.int64())], ["algorithm", "n_values", "n_bits"])

    sums = _ordered(rows, "pos", "value").mapInArrow(run, "algorithm string, n_values long, n_bits long")
    # Every name has a row, whatever the table holds.
    names = series.sparkSession.createDataFrame([(k, 0, 0) for k in algorithms], "algorithm string, n_values long, n_bits long")
    return sums.unionByName(names).groupBy("algorithm").agg(F.sum("n_values").alias("n_values"), F.sum("n_bits").alias("n_bits"))


def double_bits(x: Column) -> Column:
    """The bits of a double as a long: Spark SQL has no such cast, so a vectorised view of the column."""

    @F.pandas_udf("long")
    def view(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy("float64").view("int64"))

    return F.when(x.isNotNull(), view(x))


def _zeros(bits: Column) -> tuple[Column, Column]:
    """Leading and trailing zeros of a 64-bit number, 64 for 0."""
    right = left = bits
    for s in (1, 2, 4, 8, 16, 32):
        right = right.bitwiseOR(F.shiftrightunsigned(right, s))
        left = left.bitwiseOR(F.shiftleft(left, s))
    return 64 - F.bit_count(right), 64 - F.bit_count(left)


def gorilla_bits(series: DataFrame) -> DataFrame:
    """``(series_id, n_values, n_bits)`` of Gorilla, coded in segments.

    As window functions it would sort and hold a whole series in one task.
    """
    return compress(series, "Gorilla").groupBy("series_id").agg(F.sum("n_values").alias("n_values"), F.sum("n_bits").alias("n_bits"))
