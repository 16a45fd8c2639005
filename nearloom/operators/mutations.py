"""Changes of a vector table, as rows to be written over it.

A snapshot is ``(label, vector, doc_id, deleted, slot)``: one row per slot.
Each function gives the rows that a change writes, with GONE for labels that
vanish (:class:`nearloom.operators.snapshots.Layered`): as many as the change
names, whatever the size of the table.  Of the table only labels, slots and
flags are read for that, and the rows that a change of flags concerns.
Errors are found before, by one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearloom.operators.rows import numbered
from nearloom.operators.snapshots import GONE, small
from nearloom.shared import stored

COLUMNS = ["label", "vector", "doc_id", "deleted", "slot"]


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], "label long, vector array<double>, doc_id long, deleted boolean, slot long")


def last_written(rows: DataFrame) -> DataFrame:
    """Of rows that share a label the one that comes last; ``seq`` (made here if absent) says which that is."""
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
    w = Window.partitionBy("label").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def held(now: DataFrame, labels: DataFrame, size: int, *columns: str) -> DataFrame:
    """Of ``labels (label)``, distinct and at most ``size``, those that ``now`` has, with ``columns`` of it."""
    return now.select("label", *columns).join(small(labels, size), "label")


def upserted(now: DataFrame, rows: DataFrame, count: int, size: int) -> DataFrame:
    """What ``size`` ``rows (label, vector, doc_id)`` write over ``now`` of ``count`` slots.

    A known label keeps its slot, and is restored if it was deleted; new
    labels take the next slots in order of label.
    """
    labels = rows.select("label").distinct()
    known = stored(held(now, labels, size, "slot"), "known") if count else None
    fresh = labels if known is None else labels.join(small(known.select("label"), size), "label", "left_anti")
    slots = ranked(fresh, "slot", ["label"], count).select("label", "slot")
    return _written(rows, slots if known is None else slots.unionByName(known), size)


def _written(rows: DataFrame, slots: DataFrame, size: int) -> DataFrame:
    """The last of ``rows`` of each label, in its slot."""
    last = last_written(rows).select("label", F.col("vector").cast("array<double>").alias("vector"), "doc_id")
    return last.join(small(slots, size), "label").select("label", "vector", "doc_id", F.lit(False).alias("deleted"), "slot", F.lit(False).alias(GONE))


def ranked(rows: DataFrame, name: str, keys: list[str], start: int = 0) -> DataFrame:
    """``rows`` with ``name``: their rank from ``start`` by ``keys``; a range-partitioned sort, numbered per partition."""
    return numbered(rows.drop(name).repartitionByRange(*keys).sortWithinPartitions(*keys), name, start)


def replaced(now: DataFrame, rows: DataFrame, count: int, size: int) -> DataFrame:
    """Like :func:`upserted`, but each label that is not in ``now`` takes a deleted slot, the lowest first, while there are any.

    The label that the slot had vanishes.
    """
    labels = rows.select("label").distinct()
    known = stored(held(now, labels, size, "slot"), "known")
    fresh = ranked(labels.join(small(known.select("label"), size), "label", "left_anti"), "_rank", ["label"])
    # A deleted label that is written again is not free.
    free = now.where("deleted").select(F.col("label").alias("_old"), F.col("slot").alias("_free")).join(small(labels.withColumnRenamed("label", "_old"), size), "_old", "left_anti")
    free = stored(ranked(free, "_rank", ["_free"]), "free")
    taken = stored(fresh.join(free, "_rank", "left").withColumn("slot", F.coalesce("_free", F.col("_rank") + count - free.count())), "taken")
    written = _written(rows, taken.select("label", "slot").unionByName(known), size)
    vanished = taken.where("_old IS NOT NULL").select(F.col("_old").alias("label"))
    return written.unionByName(vanished.withColumn(GONE, F.lit(True)), allowMissingColumns=True)


def flagged(now: DataFrame, labels: DataFrame, deleted: bool, size: int) -> DataFrame:
    """The rows of ``labels (label)`` with their flag set to ``deleted``."""
    return held(now, labels, size, "vector", "doc_id", "slot").withColumns({"deleted": F.lit(deleted), GONE: F.lit(False)})


def removed(now: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Labels of ``now`` that vanish; unknown ones are ignored."""
    return held(now, labels.select("label").distinct(), size).select("label", *(F.lit(None).cast(t).alias(c) for c, t in zip(COLUMNS[1:], ("array<double>", "long", "boolean", "long"), strict=True)), F.lit(True).alias(GONE))


def from_log(log: DataFrame) -> DataFrame:
    """The state ``(label, vector, deleted)`` after a log ``(seq, op, label, vector)`` of ``add``, ``delete`` and ``undelete``.

    The vector is that of a label's last ``add``, the flag that of its last
    operation; labels that were never added are left out.  One partial
    aggregation, whatever the number of operations on a label.
    """
    added = F.when(F.col("op") == "add", F.struct("seq", "vector"))
    state = log.groupBy("label").agg(F.max_by("vector", F.when(F.col("op") == "add", F.col("seq"))).alias("vector"), (F.max_by("op", "seq") == "delete").alias("deleted"), F.count(added).alias("_adds"))
    return state.where("_adds > 0").drop("_adds")
