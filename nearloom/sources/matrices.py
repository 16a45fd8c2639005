"""Headerless comma-separated matrices of doubles, and small text configurations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$|^\s*[-+]?(?i)(nan|inf|infinity)\s*$"


def read_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """``(vector)`` per line: blank lines are skipped, tokens that are no numbers dropped, lines of another length raise.

    The length is ``width``, or that of the first line.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    tokens = F.filter(F.split("value", ","), lambda t: t.rlike(NUMBER))
    rows = lines.select(F.transform(tokens, lambda t: F.trim(t).cast("double")).alias("vector"))
    if width is None:
        first = rows.select(F.size("vector").alias("n")).first()
        width = first["n"] if first else 0
    return rows.select(F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.lit("a line has another number of columns"))).alias("vector"))


def write_csv(rows: DataFrame, path: str, vector: str = "vector", precision: int = 1) -> None:
    """Each vector as a line of fixed-point numbers with ``precision`` decimals, each the nearest to its double's exact value.

    The JVM's formatter rounds the shortest decimal form instead, so lines are formatted in Python, per Arrow batch.
    """
    shown = f"%.{precision}f"

    @F.pandas_udf("string")
    def line(v: pd.Series) -> pd.Series:
        return v.map(lambda xs: ",".join(shown % x for x in xs))

    rows.select(line(F.col(vector).cast("array<double>")).alias("value")).write.mode("overwrite").text(path)


def read_numbers(spark: SparkSession, path: str) -> list[int]:
    """The whole numbers of a one-line text configuration."""
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    return [int(t) for t in line["value"].split()] if line else []
