"""Readers and writers: CSV, text lines, parquet; guards on inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions.calendar import parse_time_day_first, time_text
from fieldcal.functions.text import parse_argument_line
from fieldcal.operators.lines import filter_lines, not_blank
from fieldcal.operators.ordering import with_positions
from fieldcal.schema import READING_SCHEMA, STATION_LIST_SCHEMA, STATION_SCHEMA, nan_to_null


# Fixed value: the files of a folder that a folder merge takes.
_FOLDER_FILES = "*.csv"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, only: str | None = None) -> DataFrame:
    """CSV with a header and an explicit schema; malformed numbers become NULL, NaN becomes NULL.

    Any file name and any compression that Spark knows; ``only`` is a pattern for the files of a folder.
    """
    options = {} if only is None else {"pathGlobFilter": only}
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, **options))


def read_readings(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    return read_csv(spark, path, READING_SCHEMA, only)


def read_station_feed(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    return read_csv(spark, path, STATION_SCHEMA, only)


def read_station_list(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, STATION_LIST_SCHEMA)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no CSV rows found")
    return df


def merged_station_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly station files of a folder as one feed in time order: decimal dot, parsed timestamps."""
    rows = require_rows(read_station_feed(spark, folder, _FOLDER_FILES))
    return rows.withColumns(
        {
            "timestamp": parse_time_day_first(F.substring_index("timestamp", ".", 1)),
            "value": F.replace("value", F.lit(","), F.lit(".")),
        }
    ).orderBy("timestamp")


def merged_readings(spark: SparkSession, folder: str) -> DataFrame:
    return require_rows(read_readings(spark, folder, _FOLDER_FILES)).orderBy("time")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; timestamps become text only here. An existing output is refused."""
    stamps = {
        f.name: time_text(F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
    }
    (df.withColumns(stamps) if stamps else df).write.mode(mode).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def filter_csv_rows(spark: SparkSession, source: str, target: str, text: str) -> None:
    """Copy the lines of a station CSV that contain a text; the header is kept."""
    lines = spark.read.schema(STATION_SCHEMA).csv(source, header=True)
    whole = lines.withColumn("_line", F.concat_ws(",", *lines.columns))
    filter_lines(whole, "_line", text).drop("_line").write.mode("errorifexists").csv(target, header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def seed_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """Seed list with its 1-based position. Lines must come from one small file, read in order."""
    placed = lines.where(not_blank(F.col(line))).withColumn("_at", F.monotonically_increasing_id())
    order = Window.partitionBy(F.lit(0)).orderBy("_at")  # a seed list is a fixed, short file
    return placed.select(
        F.row_number().over(order).alias("seed_index"), F.trim(F.col(line)).try_cast("long").alias("seed")
    )


def seed_at(seeds: DataFrame, seed_index: int) -> int:
    if seed_index < 1:
        raise ValueError(f"seed_index does not start from 1, it is {seed_index}")
    row = seeds.where(F.col("seed_index") == seed_index).first()
    if row is None:
        raise ValueError(f"there is no seed {seed_index}")
    return row["seed"]


def numbered_seeds(df: DataFrame, order: list[str], seed: str) -> DataFrame:
    """Seeds numbered from 1 in a stated order, for seed tables of any size."""
    placed = with_positions(df, order, "_p")
    return placed.select((F.col("_p") + 1).cast("int").alias("seed_index"), F.col(seed).alias("seed"))


def append_ledger(df: DataFrame, path: str) -> None:
    """Add finished-run lines to the ledger; every append is a new set of files."""
    df.select("value").write.mode("append").text(path)


def parse_ledger(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.where(not_blank(F.col(line))).select(F.col(line).alias("line"), parse_argument_line(F.col(line)).alias("arguments"))

