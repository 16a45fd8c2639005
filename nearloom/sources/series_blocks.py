"""Compressed series as a Spark data source, ``series_blocks``: rows ``(series_id, pos, value)``, stored in restartable blocks.

A task writes files of at most MOST blocks, a Parquet row group per block, under
names of their own, so neither who writes nor who reads one holds the footer
of more.  Files count once a manifest names them, which the driver writes when all
tasks are done; those of tasks or jobs that failed are never read.  Manifests
state what each file holds, and files what each of their blocks holds, as the
least and greatest of every column.  So a condition on series, position or
value opens the files and decodes the blocks that may fulfil it, and no others.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from nearloom.operators.codecs import blocks
from nearloom.session import ship
from nearloom.sources.vecs import open_path

NAME = "series_blocks"
ROW = "series_id string, pos bigint, value double"
#: Blocks of a file.
MOST = 1_024

#: By column the least and the greatest.
Bounds = dict[str, list[Any]]
Condition = tuple[str, str, list[Any]]  # column, operator, values
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "="}


def _below(a: Any, b: Any) -> bool:
    """Whether ``a < b``, a NaN being greater than any number."""
    if isinstance(b, float) and math.isnan(b):
        return not (isinstance(a, float) and math.isnan(a))
    return a < b


def may_hold(bounds: Bounds, conditions: list[Condition]) -> bool:
    """Whether a row within ``bounds`` may fulfil all ``conditions``; of several values any will do."""
    for column, operator, values in conditions:
        low, high = bounds[column]
        fits = {
            "=": lambda v: not _below(v, low) and not _below(high, v),  # noqa: B023
            ">": lambda v: _below(v, high),  # noqa: B023
            ">=": lambda v: not _below(high, v),  # noqa: B023
            "<": lambda v: _below(low, v),  # noqa: B023
            "<=": lambda v: not _below(v, low),  # noqa: B023
        }[operator]
        if not any(map(fits, values)):
            return False
    return True


def _bounds(row: dict[str, Any]) -> Bounds:
    return {"series_id": [row["series_id"], row["series_id"]], "pos": [row["first_pos"], row["last_pos"]], "value": [row["least"], row["greatest"]]}


def _around(all_: list[Bounds]) -> Bounds:
    """The bounds of what is within any of ``all_``."""
    out = {c: list(v) for c, v in all_[0].items()}
    for bounds in all_[1:]:
        for c, (low, high) in bounds.items():
            out[c] = [low if _below(low, out[c][0]) else out[c][0], high if _below(out[c][1], high) else out[c][1]]
    return out


def committed(path: str) -> list[dict[str, Any]]:
    """``name`` and ``bounds`` of the files that count: those of all manifests since the last that replaced what was before."""
    files, folder = open_path(path)
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    out: list[dict[str, Any]] = []
    for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name):
        if info.base_name.startswith("commit-") and info.base_name.endswith(".json"):
            with files.open_input_file(info.path) as f:
                found = json.loads(f.read())
            out = found["files"] if found["replaces"] else out + found["files"]
    return out


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class Reader(DataSourceReader):
    """A task per file that may hold what is asked for."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Conditions choose files and blocks; Spark asks every row of those again."""
        for f in filters:
            operator, column = _OPERATORS.get(type(f)), getattr(f, "attribute", ())
            if operator and len(column) == 1 and column[0] in ("series_id", "pos", "value") and f.value is not None:
                self.conditions.append((column[0], operator, [v for v in f.value if v is not None] if isinstance(f, In) else [f.value]))
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(f["name"]) for f in committed(self.path) if may_hold(f["bounds"], self.conditions)] or [_File("")]

    def chosen(self, part: _File) -> Iterator[tuple[pq.ParquetFile, int]]:
        """The blocks of a file that may hold what is asked for; only its footer is read."""
        if not part.name:
            return
        files, folder = open_path(self.path)
        with files.open_input_file(f"{folder}/{part.name}") as f:
            file = pq.ParquetFile(f)
            for i, bounds in enumerate(json.loads(file.metadata.metadata[b"blocks"])):
                if may_hold(bounds, self.conditions):
                    yield file, i

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        for file, i in self.chosen(part):
            for row in file.read_row_group(i).to_pylist():
                yield blocks.rows_of(row)


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict[str, Any]]


class Writer(DataSourceArrowWriter):
    """Rows must come sorted by series and position, as :func:`write` sees to."""

    def __init__(self, options: dict[str, str], replaces: bool):
        self.path, self.replaces, self.rows = options["path"], replaces, int(options.get("rows", blocks.ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = open_path(self.path)
        files.create_dir(folder, recursive=True)
        rows, written = blocks.cut((b.select(["series_id", "pos", "value"]) for b in iterator), self.rows), []
        row = next(rows, None)
        while row is not None:
            name, held = f"part-{uuid.uuid4().hex}.parquet", []
            with files.open_output_stream(f"{folder}/{name}") as out, pq.ParquetWriter(out, blocks.SCHEMA, compression="none") as file:
                while row is not None and len(held) < MOST:
                    file.write_table(pa.Table.from_pylist([row], schema=blocks.SCHEMA))
                    held.append(_bounds(row))
                    row = next(rows, None)
                file.add_key_value_metadata({"blocks": json.dumps(held)})
            written.append({"name": name, "bounds": _around(held)})
        return _Written(written)

    def commit(self, messages: list) -> None:
        """Name the files, at once."""
        files, folder = open_path(self.path)
        files.create_dir(folder, recursive=True)
        text = json.dumps({"replaces": self.replaces, "files": [f for m in messages if m is not None for f in m.files]})
        final = f"{folder}/commit-{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with files.open_output_stream(final + ".tmp") as out:
            out.write(text.encode())
        files.move(final + ".tmp", final)

    def abort(self, messages: list) -> None:
        """Remove what tasks that ended have written; what others left is named by no manifest."""
        self._delete([m for m in messages if m is not None])

    def _delete(self, messages: list) -> None:
        files, folder = open_path(self.path)
        for name in (f["name"] for m in messages for f in m.files):
            if files.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                files.delete_file(f"{folder}/{name}")


class SeriesBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to ``spark.read`` and ``df.write``, and let Spark hand conditions to Python data sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesBlocks)


def write(series: DataFrame, path: str, mode: str = "append", rows: int = blocks.ROWS, tasks: int | None = None) -> None:
    """Store ``series (series_id, pos, value)`` below ``path``, added to what is there or instead of it (``overwrite``).

    Rows are dealt to tasks by ranges of series and position.  Rows without a
    series, a position or a value are left out; an empty table adds nothing.
    """
    register(series.sparkSession)
    blocks.ordered(series, tasks).write.format(NAME).option("rows", str(rows)).mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(series_id, pos, value)`` below ``path``; filter it, and only what may fulfil the filter is read."""
    register(spark)
    return spark.read.format(NAME).load(path)
