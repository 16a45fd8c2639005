"""What the corpus operators share: Python workers, and tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from nearloom.session import ship
from nearloom.shared import cut, shared_path, stored

__all__ = ["cut", "shared_path", "ship", "slices", "stored"]

#: Rows that a Python worker turns into objects at once; Arrow batches themselves are bounded by their bytes.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``rows``; empty batches are left out."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
