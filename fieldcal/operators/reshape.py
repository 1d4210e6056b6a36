"""Column shaping, pivots, roll-ups, de-duplication and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.calendar import floor_hour


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, names: Sequence[str], required: bool = True) -> DataFrame:
    """Drop columns; with ``required=False`` absent names are ignored."""
    missing = [n for n in names if n not in df.columns]
    if required and missing:
        raise ValueError(f"columns {missing} do not exist")
    return df.drop(*names)


def move_after(df: DataFrame, column: str, anchor: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    at = rest.index(anchor) + 1
    return df.select(*rest[:at], column, *rest[at:])


def move_last_first(df: DataFrame, n: int) -> DataFrame:
    return df.select(*df.columns[-n:], *df.columns[:-n])


def move_before_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Place the named columns, where present, right before the target, which comes last."""
    present = [c for c in columns if c in df.columns]
    rest = [c for c in df.columns if c not in present and c != target]
    return df.select(*rest, *present, target)


def select_features(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features and target; an empty list keeps every column."""
    return df if not features else df.select(*features, target)


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(columns) if columns else None)


def pivot_mean(
    df: DataFrame, keys: Sequence[str], names: str, value: str, levels: Sequence[str] | None = None,
) -> DataFrame:
    """Long to wide, mean of repeated cells, one column per level.

    Conditional averages in one aggregation need a single shuffle with map-side combine.
    Without ``levels`` a distinct pass finds them first. Rows with a NULL key do not count.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    if levels is None:
        # One entry per column of the result.
        levels = sorted(r[0] for r in df.select(names).where(F.col(names).isNotNull()).distinct().collect())
    else:
        df = df.where(F.col(names).isin(list(levels)))
    kind = dict(df.dtypes)[value]
    numbers = F.nanvl(F.col(value), F.lit(None).cast(kind)) if kind in ("double", "float") else F.col(value)
    cells = [F.avg(F.when(F.col(names) == level, numbers)).alias(level) for level in levels]
    return df.groupBy(*keys).agg(*cells)


_STATS = {"mean": F.avg, "max": F.max, "min": F.min}


def hourly_rollup(
    df: DataFrame, values: Sequence[str], count_of: str, stats: Sequence[str] = ("mean", "max", "min"),
    ts: str = "timestamp", device: str = "device",
) -> DataFrame:
    """Statistics of every value column by hour and device, named ``VALUE_STAT``.

    ``NUM_MEASUREMENTS`` counts the non-null values of ``count_of``.
    """
    hours = df.withColumn(ts, floor_hour(F.col(ts)))
    aggs = [_STATS[s](c).alias(f"{c}_{s}".upper()) for c in values for s in stats]
    return hours.groupBy(ts, device).agg(*aggs, F.count(count_of).alias("NUM_MEASUREMENTS"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; a column absent in one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_zones(zones: Mapping[str, DataFrame]) -> DataFrame:
    return union_tables([df.withColumn("zone", F.lit(zone)) for zone, df in zones.items()])


def one_hot_levels(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each category by one integer column per fixed level; unknown values are all zeros."""
    kept = [c for c in df.columns if c not in levels]
    dummies: list[Column] = [
        F.coalesce((F.col(c) == level).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c in levels
        for level in levels[c]
    ]
    return df.select(*kept, *dummies)


def cap_rows(
    df: DataFrame, target: str, y_cap: float | None = None, feature: str | None = None, feature_cap: float | None = None
) -> DataFrame:
    """Keep rows at or below the caps; a missing or non-positive cap does not filter."""
    if y_cap is not None and y_cap > 0:
        df = df.where(F.col(target) <= y_cap)
    if feature is not None and feature_cap is not None and feature_cap > 0:
        df = df.where(F.col(feature) <= feature_cap)
    return df
