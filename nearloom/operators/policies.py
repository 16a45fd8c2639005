"""What a search returns of the nearest-first list of a query: always a prefix, told by a policy.

A policy says twice how long the prefix is: per task over sorted arrays, to
keep the shuffle small, and over all candidates as a window expression.  The
first must keep every row that the second reads to find the end: a row that
ends the answer without being part of it must be kept too, or the rows of
other tasks behind it would be taken for the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def nearest() -> WindowSpec:
    """A query's candidates, nearest first; ties to the smaller label."""
    return Window.partitionBy("query_id").orderBy("distance", "label")


class Policy(Protocol):
    def shortlist(self) -> int | None:
        """How many of the nearest any answer can hold, if that is known beforehand."""

    def groups(self, doc: np.ndarray) -> tuple[np.ndarray | None, int | None]:
        """``(keys, n)``: no row beyond the ``n``-th nearest of the groups of rows with equal keys is in the answer or ends it.

        No keys: any groups will do.  No ``n``: nothing is known beforehand.
        """

    def prefix(self, distance: np.ndarray, doc: np.ndarray) -> int:
        """The length of the prefix of one task's candidates, sorted nearest first, with the row that ends it."""

    def choose(self, ranked: DataFrame) -> DataFrame:
        """The answer, of all ``(query_id, label, doc_id, distance)``; adds ``rank`` from 1."""


@dataclass(frozen=True)
class TopK:
    """The ``k`` nearest."""

    k: int

    def shortlist(self) -> int | None:
        return self.k

    def groups(self, doc: np.ndarray) -> tuple[np.ndarray | None, int | None]:
        return None, self.k

    def prefix(self, distance: np.ndarray, doc: np.ndarray) -> int:
        return self.k

    def choose(self, ranked: DataFrame) -> DataFrame:
        return ranked.withColumn("rank", F.row_number().over(nearest())).where(F.col("rank") <= self.k)


@dataclass(frozen=True)
class Radius:
    """All within ``epsilon`` (squared for ``l2``), or the nearest ``most`` of them."""

    epsilon: float
    most: int | None = None

    def shortlist(self) -> int | None:
        return self.most

    def groups(self, doc: np.ndarray) -> tuple[np.ndarray | None, int | None]:
        return None, self.most

    def prefix(self, distance: np.ndarray, doc: np.ndarray) -> int:
        inside = int(np.searchsorted(distance, self.epsilon, side="right"))
        return inside if self.most is None else min(inside, self.most)

    def choose(self, ranked: DataFrame) -> DataFrame:
        inside = ranked.where(F.col("distance") <= self.epsilon).withColumn("rank", F.row_number().over(nearest()))
        return inside if self.most is None else inside.where(F.col("rank") <= self.most)


@dataclass(frozen=True)
class Documents:
    """The longest prefix over vectors of at most ``count`` different documents."""

    count: int

    def shortlist(self) -> int | None:
        return None

    def groups(self, doc: np.ndarray) -> tuple[np.ndarray | None, int | None]:
        return doc, self.count + 1  # the nearest of one document too many ends the answer

    def prefix(self, distance: np.ndarray, doc: np.ndarray) -> int:
        _, first = np.unique(doc, return_index=True)
        if len(first) <= self.count:
            return len(doc)
        return int(np.sort(first)[self.count]) + 1  # with the first row of one document too many

    def choose(self, ranked: DataFrame) -> DataFrame:
        of_doc = Window.partitionBy("query_id", "doc_id").orderBy("distance", "label")
        rows = ranked.withColumn("_new", (F.row_number().over(of_doc) == 1).cast("int"))
        rows = rows.withColumns({"_docs": F.sum("_new").over(nearest().rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(nearest())})
        return rows.where(F.col("_docs") <= self.count).drop("_new", "_docs")
