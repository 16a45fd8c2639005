"""Dense row numbers without sorting everything into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.shared import stored

#: Low bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... from ``start`` in the order of its partitions and rows.

    Each row is written once with the number of its partition and its place
    there, and all that follows reads those: how a later job partitions, prunes
    or repeats its tasks cannot change a number.  The driver sees one count
    per partition.  An empty table gives no rows.
    """
    tagged = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = tagged.withColumns({"_part": F.shiftright("_at", ROW_BITS), "_at": F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)})
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for part, n in counts:
        offsets.append((part, total))
        total += n
    before = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    # A row per partition of one job.
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")
