"""Operators on text lines: filter, count, difference, equality; parameter grids and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def not_blank(line: Column) -> Column:
    return line.rlike(r"\S")


def count_lines(df: DataFrame, line: str = "value") -> DataFrame:
    return df.where(not_blank(F.col(line))).agg(F.count("*").alias("lines"))


def filter_lines(df: DataFrame, line: str, text: str) -> DataFrame:
    """Rows that contain the text; the header is part of the schema and stays."""
    return df.where(F.contains(F.col(line), F.lit(text)))


def _digest(line: str) -> Column:
    """Lines are compared by SHA-256, so whole texts need not travel through the shuffle twice."""
    return F.sha2(F.col(line), 256)


def lines_only_in_first(first: DataFrame, second: DataFrame, line: str = "value") -> DataFrame:
    """Non-blank lines of the first table that the second does not hold; duplicates stay.

    The second side shrinks to its distinct digests first, so a line repeated many times there costs one row.
    """
    a = first.where(not_blank(F.col(line))).withColumn("_digest", _digest(line))
    b = second.where(not_blank(F.col(line))).select(_digest(line).alias("_digest")).distinct()
    return a.join(b, "_digest", "left_anti").drop("_digest")


def same_lines(first: DataFrame, second: DataFrame, line: str = "value") -> DataFrame:
    """One row: do both tables hold the same non-blank lines equally often?

    Both sides are counted together in one pass; ``differing`` is the number of lines whose counts differ.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.where(not_blank(F.col(line))).select(_digest(line).alias("_digest"), F.lit(sign).alias("_side"))

    balance = side(first, 1).unionByName(side(second, -1)).groupBy("_digest").agg(F.sum("_side").alias("_balance"))
    return balance.agg(F.count_if(F.col("_balance") != 0).alias("differing")).withColumn(
        "same", F.col("differing") == 0
    )


def expand_grid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All combinations of the array columns of each row, one ``explode`` per column."""
    for column in columns:
        df = df.withColumn(column, F.explode(column))
    return df


def parameter_grid(spark: SparkSession, grid: Mapping[str, Any]) -> DataFrame:
    """A grid given as lists (a scalar counts as one item) as one row of text arrays, expanded."""
    arrays = [
        F.array(*[F.lit(str(v)) for v in (values if isinstance(values, list) else [values])]).alias(name)
        for name, values in grid.items()
    ]
    return expand_grid(spark.range(1).select(*arrays), list(grid))


def runs_left(plan: DataFrame, done: DataFrame, line: str = "line") -> DataFrame:
    return lines_only_in_first(plan, done, line)
