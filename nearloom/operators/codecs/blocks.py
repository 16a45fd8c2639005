"""Series in restartable blocks: each is coded by itself, by the codec that makes it smallest, and says what it holds.

Rows are dealt to tasks by ranges of series and position, so one long series
keeps every task busy, when it is coded and when it is read.  A block starts
with a fresh codec, so it can be decoded without those before it; it costs the
bits that a codec needs to start.  Its first and last position and its least
and greatest value tell whether it has anything to do with a question.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.operators.codecs import bulk
from nearloom.operators.codecs.bits import BitReader
from nearloom.operators.codecs.registry import decoder, encoder
from nearloom.session import ship

#: Values of a block, at most.
ROWS = 16_384
#: Codecs and settings that are tried on each block; the first of equally small ones is taken.
TRIED: tuple[tuple[str, dict[str, int] | None], ...] = (("Gorilla", None), ("Elf", None), ("Camel", None), ("DeXOR", None), ("DeXOR", {"buffer_bits": 3}))
#: Values of the blocks that are coded together, about.
GROUP = 32_768

BLOCK = "series_id string, first_pos long, last_pos long, least double, greatest double, n_values long, n_bits long, codec string, config string, positions binary, data binary"
SCHEMA = pa.schema(
    [("series_id", pa.string()), *((c, pa.int64()) for c in ("first_pos", "last_pos")), *((c, pa.float64()) for c in ("least", "greatest")), *((c, pa.int64()) for c in ("n_values", "n_bits")), *((c, pa.string()) for c in ("codec", "config")), *((c, pa.binary()) for c in ("positions", "data"))]
)


def ranges(values: np.ndarray) -> tuple[float, float]:
    """The least and greatest value, a NaN being greater than any number as in comparisons of SQL."""
    real = values[~np.isnan(values)]
    return (float(real.min()) if len(real) else math.nan), (math.nan if len(real) < len(values) else float(real.max()))


def coded(held: Sequence[tuple[str, np.ndarray, np.ndarray]], tried: Sequence[tuple[str, dict[str, int] | None]] = TRIED) -> Iterator[dict[str, Any]]:
    """Rows of BLOCK for blocks ``(series_id, positions, values)``, whose positions ascend."""
    if not held:
        return
    starts = np.cumsum([0, *(len(v) for *_, v in held)])[:-1]
    for (series_id, positions, values), (at, data, bits) in zip(held, bulk.smallest(np.concatenate([v for *_, v in held]), starts, tried), strict=True):
        least, greatest = ranges(values)
        steps = np.diff(positions, prepend=positions[:1]).astype("<i8").tobytes()
        yield {
            "series_id": series_id, "first_pos": int(positions[0]), "last_pos": int(positions[-1]), "least": least, "greatest": greatest, "n_values": len(values), "n_bits": bits,
            "codec": tried[at][0], "config": json.dumps(tried[at][1] or {}, sort_keys=True), "positions": zlib.compress(steps, 6), "data": data,
        }


def opened(row: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """The positions and values of a block."""
    state, bits = decoder(row["codec"], json.loads(row["config"])), BitReader(row["data"], row["n_bits"])
    values = np.array([state.decode(bits) for _ in range(row["n_values"])])
    return row["first_pos"] + np.cumsum(np.frombuffer(zlib.decompress(row["positions"]), "<i8")), values


def cut(batches: Iterator[pa.RecordBatch], rows: int = ROWS, tried: Sequence[tuple[str, dict[str, int] | None]] = TRIED) -> Iterator[dict[str, Any]]:
    """The blocks of sorted batches ``(series_id, pos, value)``; holds the rows of a group of blocks, which are coded together."""
    now, held, count = None, [], 0
    group: list[tuple[str, np.ndarray, np.ndarray]] = []
    waiting = 0

    def close() -> None:
        nonlocal waiting
        if held:
            group.append((now, np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held])))
            waiting += len(group[-1][2])
            held.clear()

    def done() -> Iterator[dict[str, Any]]:
        nonlocal waiting
        yield from coded(group, tried)
        group.clear()
        waiting = 0

    for b in batches:
        if not b.num_rows:
            continue
        sid, pos, value = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]]))
        for i, j in zip(starts, [*starts[1:], len(sid)], strict=True):
            if sid[i] != now:
                close()
                now, count = sid[i], 0
            while i < j:
                take = min(j - i, rows - count)
                held.append((pos[i : i + take], value[i : i + take]))
                i, count = i + take, count + take
                if count == rows:
                    close()
                    count = 0
                if waiting >= GROUP:
                    yield from done()
    close()
    yield from done()


def batched(found: Iterator[dict[str, Any]]) -> Iterator[list[dict[str, Any]]]:
    """Blocks in groups of about GROUP values."""
    group, n = [], 0
    for row in found:
        group.append(row)
        n += row["n_values"]
        if n >= GROUP:
            yield group
            group, n = [], 0
    if group:
        yield group


def ordered(series: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(series_id, pos, value)`` in ranges of series, position and value; rows without a series, a position or a value are left out."""
    rows = series.select(F.col("series_id").cast("string"), F.col("pos").cast("long"), F.col("value").cast("double")).where("series_id IS NOT NULL AND pos IS NOT NULL AND value IS NOT NULL")
    by = ["series_id", "pos", "value"]
    return (rows.repartitionByRange(*by) if tasks is None else rows.repartitionByRange(tasks, *by)).sortWithinPartitions(*by)


def compress(series: DataFrame, rows: int = ROWS, tried: Sequence[tuple[str, dict[str, int] | None]] = TRIED, tasks: int | None = None) -> DataFrame:
    """The blocks (BLOCK) of each series in order of ``pos`` and ``value``, cut wherever a task's range or ``rows`` values end.

    An empty table gives no rows.  Where blocks are cut depends on the ranges;
    what they hold together does not.
    """
    for codec, config in tried:
        encoder(codec, config)  # unknown names and parameters raise here
    ship(series.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batched(cut(batches, rows, tried)):
            yield pa.RecordBatch.from_pylist(found, schema=SCHEMA)

    return ordered(series, tasks).mapInArrow(run, BLOCK)


def decompress(blocks: DataFrame) -> DataFrame:
    """``(series_id, pos, value)`` of blocks in any order; without a shuffle, as each is read by itself."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield rows_of(b.slice(i, 1).to_pylist()[0])

    return blocks.select(*SCHEMA.names).mapInArrow(run, "series_id string, pos long, value double")


def rows_of(row: dict[str, Any]) -> pa.RecordBatch:
    """The rows of a block."""
    pos, values = opened(row)
    return pa.RecordBatch.from_arrays([pa.array([row["series_id"]] * len(pos), pa.string()), pa.array(pos.astype(np.int64)), pa.array(values, pa.float64())], ["series_id", "pos", "value"])


def sizes(blocks: DataFrame, tried: Sequence[tuple[str, dict[str, int] | None]] = TRIED) -> DataFrame:
    """``(n_values, n_bits, each)`` of blocks: what they take, and what each codec alone would take for their values."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batched(b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            values = [opened(row)[1] for row in found]
            starts = np.cumsum([0, *map(len, values)])[:-1]
            each = bulk.sizes(np.concatenate(values), starts, tried).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(len, values)), pa.int64()), pa.array([row["n_bits"] for row in found], pa.int64()), pa.array(each, pa.list_(pa.int64()))], ["n_values", "n_bits", "each"])

    return blocks.select(*SCHEMA.names).mapInArrow(run, "n_values long, n_bits long, each array<long>")


def within(first: int | None = None, last: int | None = None, least: float | None = None, greatest: float | None = None) -> Column:
    """Whether a block may hold a row of these positions and values, ends included; null: no bound."""
    out = F.lit(True)
    for bound, keep in ((first, lambda x: F.col("last_pos") >= x), (last, lambda x: F.col("first_pos") <= x), (least, lambda x: F.col("greatest") >= x), (greatest, lambda x: ~(F.col("least") > x))):
        if bound is not None:
            out = out & keep(bound)
    return out


def read_range(blocks: DataFrame, first: int | None = None, last: int | None = None, least: float | None = None, greatest: float | None = None) -> DataFrame:
    """The rows of a range of positions and values; only blocks that may hold any are decoded."""
    rows = decompress(blocks.where(within(first, last, least, greatest)))
    for bound, keep in ((first, lambda x: F.col("pos") >= x), (last, lambda x: F.col("pos") <= x), (least, lambda x: F.col("value") >= x), (greatest, lambda x: F.col("value") <= x)):
        if bound is not None:
            rows = rows.where(keep(bound))
    return rows
