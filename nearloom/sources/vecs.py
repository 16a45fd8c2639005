"""Vector files as Spark data sources: ``bvecs``, ``ivecs``, ``fvecs`` and headerless matrices.

A record of a ``*vecs`` file is a 32-bit length and so many components; all
records are alike, so a file splits at any multiple of the record's size, and
each task reads its own range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nearloom.session import ship

# Components of each format: numpy type, Spark type.
KINDS = {"bvecs": ("u1", "smallint"), "ivecs": ("<i4", "int"), "fvecs": ("<f4", "float"), "raw_f32": ("<f4", "float"), "raw_i32": ("<i4", "int")}
SPLIT = 32 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and name of a path or URI; Hadoop writes local ones with a single slash."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, row: int):
        self.path, self.first, self.count, self.row = path, first, count, row


class _Reader(DataSourceReader):
    """Reads a file, or all files of a folder in order of their names."""

    def __init__(self, options: dict[str, str], kind: str):
        self.kind, self.path = kind, options["path"]
        self.item = np.dtype(KINDS[kind][0])
        self.head = 0 if kind.startswith("raw") else 4
        files, name = open_path(self.path)
        info = files.get_file_info(name)
        listed = files.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
        self.sizes = sorted((f.path, f.size) for f in listed if f.is_file and not f.base_name.startswith(("_", ".")) and f.size)
        self.dim = int(options.get("dim", 0))
        if self.head and self.sizes:
            with files.open_input_file(self.sizes[0][0]) as f:
                found = int(np.frombuffer(f.read(4), "<i4")[0])
            if self.dim not in (0, found):
                raise ValueError(f"{self.path}: records have {found} components, not {self.dim}")
            self.dim = found
        self.record = max(1, self.head + self.dim * self.item.itemsize)
        for path, size in self.sizes:
            if size % self.record:
                raise ValueError(f"{path}: {size} bytes are no multiple of {self.record}")
        self.split = max(1, int(options.get("split", SPLIT)) // self.record)

    def partitions(self) -> list[InputPartition]:
        out, row = [], 0
        for path, size in self.sizes:
            total = size // self.record
            out += [_Range(path, i, min(self.split, total - i), row + i) for i in range(0, total, self.split)]
            row += total
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        files, _ = open_path(self.path)
        with files.open_input_file(part.path) as f:
            for first in range(0, part.count, 10_000):
                n = min(10_000, part.count - first)
                f.seek((part.first + first) * self.record)
                raw = np.frombuffer(f.read(n * self.record), np.uint8).reshape(n, self.record)
                if self.head and (raw[:, :4].copy().view("<i4") != self.dim).any():
                    raise ValueError(f"{part.path}: a record has another number of components")
                values = raw[:, self.head :].copy().view(self.item).ravel()
                values = values.astype({"u1": np.int16}.get(KINDS[self.kind][0], self.item))
                offsets = pa.array(np.arange(n + 1) * self.dim, pa.int32())
                rows = pa.array(np.arange(part.row + first, part.row + first + n))
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(offsets, pa.array(values))], ["row", "vector"])


def _source(kind: str) -> type[DataSource]:
    class Vecs(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return f"row bigint, vector array<{KINDS[kind][1]}>"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), kind)

    return Vecs


def register(spark: SparkSession) -> None:
    """Make the formats known to ``spark.read.format``."""
    ship(spark)
    for kind in KINDS:
        spark.dataSource.register(_source(kind))


def read(spark: SparkSession, path: str, kind: str, dim: int | None = None, split: int = SPLIT) -> DataFrame:
    """``(row, vector)`` of a file; ``dim`` is needed for raw matrices and checked for the others."""
    register(spark)
    options = {"split": str(split)} | ({} if dim is None else {"dim": str(dim)})
    return spark.read.format(kind).options(**options).load(path)


def encode(rows: np.ndarray, kind: str) -> bytes:
    """A matrix as the bytes of a file of ``kind``."""
    body = np.ascontiguousarray(rows.astype(KINDS[kind][0])).view(np.uint8).reshape(len(rows), -1)
    if not kind.startswith("raw"):
        head = np.full((len(rows), 1), rows.shape[1], "<i4").view(np.uint8)
        body = np.concatenate([head, body], axis=1)
    return body.tobytes()


def write(df: DataFrame, path: str, kind: str, vector: str = "vector") -> None:
    """Vectors as files of ``kind`` in the folder ``path``, one per task, whole once they have their names."""
    ship(df.sparkSession)
    files, name = open_path(path)
    files.create_dir(name, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, name = open_path(path)
        part, count = TaskContext.get().partitionId(), 0
        own = f"{name}/_{part:06d}-{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(own) as out:
            for b in batches:
                sizes = pa.compute.list_value_length(b.column(0)).to_numpy(zero_copy_only=False)
                if len(sizes) and (b.column(0).null_count or (sizes != sizes[0]).any()):
                    raise ValueError("vectors must be there and of one length")
                if len(sizes):
                    out.write(encode(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1), kind))
                count += len(sizes)
        final = f"{name}/part-{part:06d}.{kind}"
        if files.get_file_info(final).type != fs.FileType.NotFound:
            files.delete_file(final)  # of a lost run of this task
        files.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    df.select(vector).mapInArrow(run, "n long").agg({"n": "sum"}).collect()
