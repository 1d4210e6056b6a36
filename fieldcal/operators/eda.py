"""Exploratory summaries as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.text import header_label
from fieldcal.operators.quantiles import QUARTILES, column_quantiles, exact_quantiles
from fieldcal.schema import numeric_columns, text_columns
from fieldcal.session import durable


def sign_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: does a column hold any negative value?"""
    return df.agg(*[F.coalesce(F.bool_or(F.col(c) < 0), F.lit(False)).alias(c) for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column, type, row count and null count, from one pass."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                        F.col("_rows").alias("rows"), F.col(f"n{i}").alias("nulls"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    also = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = column_quantiles(df, columns, QUARTILES, also=also).withColumnRenamed("n", "count")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # columns without any value stay
    return every.join(found, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q1", "median", "q3", "max"
    )


def score_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """min, exact quartiles, max, mean and population deviation per group of any size."""
    also = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    return exact_quantiles(df, value, QUARTILES, keys, also=also).select(
        *keys, "n", "min", "q1", "median", "q3", "max", "mean", "std"
    )


def seed_score_summary(df: DataFrame, value: str, seed: str, keys: Sequence[str]) -> DataFrame:
    """The same summary for scores of one run per seed, with the score list in seed order.

    Only for groups with one row per seed, whose number is fixed by the experiment plan.
    """
    ordered = F.array_sort(F.collect_list(F.struct(seed, value)))
    return df.groupBy(*keys).agg(
        F.transform(ordered, lambda s: s[value]).alias("scores"),
        F.min(value).alias("min"),
        *[F.percentile(value, F.lit(p)).alias(name) for name, p in QUARTILES.items()],
        F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, long form, from one pass."""
    columns = list(columns or numeric_columns(df))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = df.agg(
        *[F.corr(columns[i], columns[j]).alias(f"r_{i}_{j}") for i, j in pairs],
        *[F.var_pop(c).alias(f"v_{i}") for i, c in enumerate(columns)],
    )
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            r = F.when(F.col(f"v_{i}") > 0, F.lit(1.0)) if i == j else F.col(f"r_{min(i, j)}_{max(i, j)}")
            cells.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), r.alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between minimum and maximum; the top edge belongs to the last bin. Empty bins show 0."""
    edges = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    limits = {c: (edges[f"lo{i}"], edges[f"hi{i}"]) for i, c in enumerate(columns) if edges[f"lo{i}"] is not None}
    if not limits:
        raise ValueError("no values to count")

    def bin_of(c: str) -> Column:
        lo, hi = limits[c]
        if hi == lo:
            return F.when(F.col(c).isNotNull(), 0)
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / (hi - lo) * bins).cast("int"))

    counted = (
        df.select([bin_of(c).alias(c) for c in limits])
        .unpivot([], list(limits), "column", "bin")
        .where("bin is not null")
        .groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )
    frame = df.sparkSession.createDataFrame(
        [(c, b, lo + (hi - lo) / bins * b) for c, (lo, hi) in limits.items() for b in range(bins)],
        "column string, bin int, left double",
    )
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "left", F.coalesce("n", F.lit(0)).alias("n")
    )


def _density_sums(batches: Iterator[pa.RecordBatch], grid_size: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, value, count, bandwidth, lowest grid point, step) → one vector of kernel sums per group of the task."""
    sums: dict[int, np.ndarray] = {}
    at = np.arange(grid_size)
    for batch in batches:
        group, v, c, h, lo, step = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if not len(rows):
                continue
            first = rows[0]
            x = lo[first] + step[first] * at
            total = sums.setdefault(int(group[first]), np.zeros(grid_size))
            for part in range(0, len(rows), 4096):  # a bounded matrix at a time
                some = rows[part : part + 4096]
                z = (x[None, :] - v[some, None]) / h[first]
                total += (c[some, None] * np.exp(-z * z / 2)).sum(axis=0)
    names = ["_group", "_sums"]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()])], names)


def density_by_category(
    df: DataFrame, category: str, value: str, grid_size: int = 200, cut: float = 3.0, floor: float = 0.0
) -> DataFrame:
    """Gaussian kernel density per category on an even grid, cut at ``floor``; Scott's bandwidth.

    Equal values are collapsed first; each task then adds up one vector per category, and only these vectors are
    shuffled. Every category with a spread has all its grid points, also those far from any value.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.col(category).alias("_c"), v.alias("_v")).where("_c is not null and _v is not null")
    stats = (
        rows.groupBy("_c")
        .agg(F.count("*").alias("_n"), F.stddev_samp("_v").alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        .where("_s > 0")
        .withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
        .withColumn("_lo", F.greatest(F.col("_min") - cut * F.col("_h"), F.lit(float(floor))))
        .withColumn("_step", (F.col("_max") + cut * F.col("_h") - F.col("_lo")) / (grid_size - 1))
        .select(F.monotonically_increasing_id().alias("_group"), "_c", "_n", "_h", "_lo", "_step")
    )
    stats = durable(stats)  # one row per category, with a number that every later read agrees on
    collapsed = rows.groupBy("_c", "_v").agg(F.count("*").alias("_k"))
    placed = collapsed.join(stats, "_c").select("_group", "_v", F.col("_k").cast("double"), "_h", "_lo", "_step")
    sums = placed.mapInArrow(lambda b: _density_sums(b, grid_size), "_group long, _sums array<double>")
    points = sums.select("_group", F.posexplode("_sums").alias("grid", "_d")).groupBy("_group", "grid").agg(F.sum("_d").alias("_d"))
    every = stats.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))))
    norm = F.col("_n") * F.col("_h") * F.lit(2.5066282746310002)
    return every.join(points, ["_group", "grid"], "left").select(
        F.col("_c").alias(category), "grid", (F.col("_lo") + F.col("_step") * F.col("grid")).alias("x"),
        F.coalesce(F.col("_d") / norm, F.lit(0.0)).alias("density"),
    )


def capitalized_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Capitalise the header and the values of the text columns."""
    from fieldcal.functions.text import capitalize

    columns = list(columns or text_columns(df))
    return df.select(
        *[capitalize(F.col(c)).alias(header_label(c)) if c in columns else F.col(c) for c in df.columns]
    )


def eda_report(
    df: DataFrame, columns: Sequence[str], category: str | Sequence[str] | None = None
) -> Mapping[str, DataFrame]:
    """All report tables by name; with categories a density table for each (``density`` alone for a single name)."""
    report = {
        "signs": sign_check(df, columns),
        "describe": describe(df, columns),
        "nulls": null_counts(df),
        "correlation": correlation_matrix(df, columns),
        "histogram": histogram(df, columns),
    }
    single = isinstance(category, str)
    for name in [category] if single else category or []:
        report["density" if single else f"density_{name}"] = density_by_category(df, name, list(columns)[-1])
    return report
