"""Run results: nested JSON to a flat score table and back, layout keys, failure log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions.text import adler32
from fieldcal.schema import RUN_SCALARS, ZONE_SCORES

SCORE_KINDS = ["train_score", "test_score", "train_score_sum_cocal", "test_score_sum_cocal"]


def read_results(spark: SparkSession, path: str, zones: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Run records with one map column (metric → scores) per zone."""
    schema = T.StructType([*RUN_SCALARS.fields, *[T.StructField(z, ZONE_SCORES) for z in zones]])
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def flatten_results(results: DataFrame, zones: Sequence[str], keys: Sequence[str] = ("run_id", "seed_index")) -> DataFrame:
    """One row per run, zone, metric and score kind."""
    by_zone = F.map_from_arrays(F.array(*[F.lit(z) for z in zones]), F.array(*[F.col(z) for z in zones]))
    per_zone = results.select(*keys, F.explode(by_zone).alias("zone", "_metrics"))
    per_metric = per_zone.select(*keys, "zone", F.explode("_metrics").alias("metric", "_s"))
    wide = per_metric.select(*keys, "zone", "metric", *[F.col(f"_s.{k}").alias(k) for k in SCORE_KINDS])
    return wide.unpivot([*keys, "zone", "metric"], SCORE_KINDS, "kind", "score")


def nest_results(scores: DataFrame, zones: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Flat scores (zone, metric, the four score kinds) back to one nested record per run.

    A run holds one row per zone and metric, a number fixed by the experiment.
    """
    entry = F.struct(F.col("metric"), F.struct(*SCORE_KINDS))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("zone") == z, entry)))).alias(z) for z in zones]
    return scores.groupBy(*keys).agg(*maps)


#: A run is known by these, besides its layout keys.
RUN_KEY = ("run_id", "seed_index")


def write_results(records: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write run records as JSON, in one folder for each layout key, run and seed.

    A folder that is written again is replaced and all others stay, so a rerun leaves one record.
    """
    folders = [*partition_by, *[k for k in RUN_KEY if k in records.columns and k not in partition_by]]
    if not folders:
        records.write.mode("append").json(path)
        return
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).json(path)


def flag_digit(value: Column) -> Column:
    return (value != 0).cast("int").cast("string")


def layout_path(
    base: str, dataset: Column, features: Column, encoding: Column, scaling: Column, augmentation: Column,
    model: Column, test_size: Column, n_iter: Column, cv: Column, linear_scaling: Column, log_scale_target: Column,
    n_train_records: Column,
) -> Column:
    """Result folder of a run, from its parameters; dots in numbers become ``d``."""
    def dotless(c: Column) -> Column:
        return F.replace(c.cast("string"), F.lit("."), F.lit("d"))

    recipe = F.concat_ws("_", encoding, scaling, dotless(augmentation), model)
    setup = F.concat(
        F.lit("test"), dotless(test_size), F.lit("cviter"), n_iter.cast("string"), F.lit("cvfold"), cv.cast("string"),
        F.lit("linscale"), flag_digit(linear_scaling), F.lit("logscaletarget"), flag_digit(log_scale_target),
        F.lit("ntrain"), n_train_records.cast("string"),
    )
    return F.concat(F.concat_ws("/", F.lit(base.strip().rstrip("/")), dataset, features, recipe, setup), F.lit("/"))


def feature_list_key(features: Column) -> Column:
    return F.concat(F.lit("features"), adler32(features).cast("string"))


def failure_log(runs: DataFrame, arguments: str, error: str) -> DataFrame:
    """Failed runs with their key: the checksum of the argument line."""
    return runs.where(F.col(error).isNotNull()).select(
        F.concat(F.lit("error_"), adler32(F.col(arguments)).cast("string")).alias("error_key"), arguments, error
    )
