"""Input schemas, fixed level lists and the one-time NaN-to-NULL rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Level names, sensor names and the device that does not move.
SEASONS = ["autumn", "spring", "summer", "winter"]
TIMES_OF_DAY = ["afternoon", "evening", "morning", "night"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
IGNORED_SENSORS = ["AN_CO2", "DF_O3", "WI_O2"]
STATIC_DEVICE = "CAMO004"
MISSING_VALUE = "N/D"

READING_COLUMNS = ["time", "lon", "lat", "device", "sensor", "val", "gps_kmh", "gps_dir", "gps_alt"]
STATION_COLUMNS = ["timestamp", "station", "parameter", "value", "unit", "validation"]
CALENDAR_COLUMNS = [
    "month", "hour", "day_of_week", "day_of_month", "week_of_month", "season", "weekend", "time_of_day",
]

READING_SCHEMA = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("device", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("val", T.DoubleType()),
        T.StructField("gps_kmh", T.DoubleType()),
        T.StructField("gps_dir", T.DoubleType()),
        T.StructField("gps_alt", T.DoubleType()),
    ]
)
STATION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STATION_COLUMNS])
STATION_LIST_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("address", T.StringType()),
    ]
)

_SCORE = T.StructType(
    [
        T.StructField(c, T.DoubleType())
        for c in ("train_score", "test_score", "train_score_sum_cocal", "test_score_sum_cocal")
    ]
)
RUN_SCALARS = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("seed_index", T.IntegerType()),
        T.StructField("selected_features", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("timestamps", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("execution_time_in_minutes", T.DoubleType()),
    ]
)
ZONE_SCORES = T.MapType(T.StringType(), _SCORE)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that NULL is the only missing value.

    Aggregates skip NULL but spread NaN; calling this once at load gives the usual
    "missing values are skipped" semantics everywhere after it.
    """
    floats = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df
