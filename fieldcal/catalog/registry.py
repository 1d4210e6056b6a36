"""Registration of queries and views of the given tables under calibration names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.operators.metrics import metric_columns, metrics_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double: sums differ in the last bits with the order of addition."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles}) if doubles else df


def sql_rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


# ---------------------------------------------------------------- readings from events

REF_LAT, REF_LON = 45.6544, 13.789
_EVENT_SENSORS = {"click": "PM10", "view": "PM25", "error": "BM_T", "purchase": "BM_H", "signup": "BM_P"}


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long reading per event."""
    sensor = F.create_map(*[F.lit(x) for pair in _EVENT_SENSORS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("string").alias("time"),
        (F.lit(REF_LON) + (F.col("user_id") % 7) * F.lit(0.01)).alias("lon"),
        (F.lit(REF_LAT) + (F.col("user_id") % 5) * F.lit(0.01)).alias("lat"),
        F.concat(F.lit("CAMO00"), (F.col("user_id") % 5).cast("string")).alias("device"),
        F.element_at(sensor, F.col("event_type")).alias("sensor"),
        F.col("value").alias("val"),
        (F.col("event_id") % 50).cast("double").alias("gps_kmh"),
        (F.col("event_id") % 360).cast("double").alias("gps_dir"),
        (F.col("event_id") % 300).cast("double").alias("gps_alt"),
    )


EVENT_READINGS_SQL = """
event_readings AS (
  SELECT event_id, ts, date_trunc('second', ts) AS sec,
         13.789::DOUBLE + (user_id % 7) * 0.01::DOUBLE AS lon,
         45.6544::DOUBLE + (user_id % 5) * 0.01::DOUBLE AS lat,
         'CAMO00' || (user_id % 5) AS device,
         CASE event_type WHEN 'click' THEN 'PM10' WHEN 'view' THEN 'PM25' WHEN 'error' THEN 'BM_T'
              WHEN 'purchase' THEN 'BM_H' WHEN 'signup' THEN 'BM_P' END AS sensor,
         value AS val, (event_id % 50)::DOUBLE AS gps_kmh, (event_id % 360)::DOUBLE AS gps_dir,
         (event_id % 300)::DOUBLE AS gps_alt
  FROM events)"""

# ---------------------------------------------------------------- dense readings from lineitem

DENSE_SENSORS = ["BM_H", "BM_P", "BM_T", "PM10", "PM25"]


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five or six long readings per line item: every sensor of one device at one second."""
    li = lines(spark, sf_dir)
    at = F.col("l_shipdate") + F.make_dt_interval(
        F.lit(0), (F.col("l_orderkey") % 24).cast("int"), (F.col("l_partkey") % 60).cast("int"),
        (F.col("l_linenumber") * 7).cast("decimal(18,6)"),
    )

    def one(sensor: str, value: Column) -> Column:
        return F.struct(F.lit(sensor).alias("sensor"), value.cast("double").alias("val"))

    sensors = F.array(
        one("PM10", F.col("l_extendedprice") / 2003),
        one("PM25", F.col("l_extendedprice") / 3011),
        one("BM_T", F.col("l_tax") * 400),
        one("BM_H", F.col("l_discount") * 1000),
        one("BM_P", F.col("l_quantity") / 2 + 990),
        one("AN_CO2", F.col("l_quantity")),
    )
    wide = li.select(  # one text for all readings of a line
        F.concat(at.cast("string"), F.lit(".500")).alias("time"),
        (F.lit(REF_LON) + (F.col("l_partkey") % 11 - 5) * F.lit(0.004)).alias("lon"),
        (F.lit(REF_LAT) + (F.col("l_partkey") % 13 - 6) * F.lit(0.004)).alias("lat"),
        F.concat(F.lit("CAMO00"), (F.col("l_suppkey") % 5).cast("string")).alias("device"),
        F.col("l_quantity").alias("gps_kmh"),
        (F.col("l_partkey") % 360).cast("double").alias("gps_dir"),
        (F.col("l_suppkey") % 300).cast("double").alias("gps_alt"),
        sensors.alias("sensors"),
    )
    columns = ["time", "lon", "lat", "device"], ["gps_kmh", "gps_dir", "gps_alt"]
    return wide.select(*columns[0], F.inline("sensors"), *columns[1])


LINEITEM_READINGS_SQL = """
dense AS (
  SELECT l_shipdate + to_hours(l_orderkey % 24) + to_minutes(l_partkey % 60) + to_seconds(l_linenumber * 7) AS ts,
         13.789::DOUBLE + (l_partkey % 11 - 5) * 0.004::DOUBLE AS lon,
         45.6544::DOUBLE + (l_partkey % 13 - 6) * 0.004::DOUBLE AS lat,
         'CAMO00' || (l_suppkey % 5) AS device,
         l_quantity AS gps_kmh, (l_partkey % 360)::DOUBLE AS gps_dir, (l_suppkey % 300)::DOUBLE AS gps_alt,
         l_extendedprice / 2003 AS "PM10", l_extendedprice / 3011 AS "PM25", l_tax * 400 AS "BM_T",
         l_discount * 1000 AS "BM_H", l_quantity / 2 + 990 AS "BM_P"
  FROM lineitem),
dense_wide AS (
  SELECT ts, lat, lon, device, gps_kmh, gps_dir, gps_alt, avg("BM_H") AS "BM_H", avg("BM_P") AS "BM_P",
         avg("BM_T") AS "BM_T", avg("PM10") AS "PM10", avg("PM25") AS "PM25"
  FROM dense GROUP BY ts, lat, lon, device, gps_kmh, gps_dir, gps_alt),
dense_dew AS (
  SELECT *, CASE WHEN "BM_H" > 0 THEN
    243.04::DOUBLE * (17.625::DOUBLE * "BM_T" / (243.04::DOUBLE + "BM_T") + ln("BM_H" / 100))
      / (17.625::DOUBLE - (17.625::DOUBLE * "BM_T" / (243.04::DOUBLE + "BM_T") + ln("BM_H" / 100))) END AS dew_point
  FROM dense_wide)"""


def sql_distance(lat: str, lon: str, ref_lat: str, ref_lon: str) -> str:
    a = (
        f"(pow(sin(radians({lat} - ({ref_lat})) / 2), 2) + cos(radians({lat})) * cos(radians({ref_lat}))"
        f" * pow(sin(radians({lon} - ({ref_lon})) / 2), 2))"
    )
    return f"(2 * 6371000 * atan2(sqrt({a}), sqrt(1 - {a})))"


# ---------------------------------------------------------------- station feed from orders, station list from supplier

STATION = "Supplier#000000001"
PM10_PARAMETER = "Particelle sospese PM10"


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw station feed, six text columns: local time, decimal comma and the missing-value mark."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    parameter = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), PM10_PARAMETER)
        .when(F.col("o_orderpriority") == "3-MEDIUM", "PM2.5")
        .otherwise("Biossido di azoto")
    )
    value = F.when(F.col("o_orderkey") % 50 == 0, "N/D").otherwise(
        F.replace((F.col("o_totalprice") / 5000).cast("string"), F.lit("."), F.lit(","))
    )
    return o.select(
        F.concat(at.cast("string"), F.lit(".0")).alias("timestamp"),
        F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 4).cast("string"), 9, "0")).alias("station"),
        parameter.alias("parameter"), value.alias("value"), F.lit("ug/m3").alias("unit"),
        F.col("o_orderstatus").alias("validation"),
    )


STATION_ROWS_SQL = """
station_rows AS (
  SELECT o_orderdate + to_hours(o_orderkey % 24) AS local_ts,
         'Supplier#' || lpad((o_custkey % 4)::VARCHAR, 9, '0') AS station,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Particelle sospese PM10'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'PM2.5' ELSE 'Biossido di azoto' END AS parameter,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice / 5000 END AS value
  FROM orders)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_name").alias("station"),
        (F.lit(REF_LON) + (F.col("s_suppkey") % 9) * F.lit(0.002)).alias("lon"),
        (F.lit(REF_LAT) + (F.col("s_suppkey") % 7) * F.lit(0.002)).alias("lat"),
        F.col("n_name").alias("address"),
    )


STATIONS_SQL = """
stations AS (
  SELECT s_name AS station, 13.789::DOUBLE + (s_suppkey % 9) * 0.002::DOUBLE AS lon,
         45.6544::DOUBLE + (s_suppkey % 7) * 0.002::DOUBLE AS lat, n_name AS address
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

# ---------------------------------------------------------------- truth/raw pairs and run scores from lineitem


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table, for queries with much work per row."""
    return table(spark, sf_dir, "lineitem")


LINE_KEY = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
MODELS = ["cocal_only", "linear", "random_forest", "gradient_boosting", "mlp"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and raw value per line item, with a zone, categories and a time."""
    return lines(spark, sf_dir).select(
        "*",
        (F.col("l_extendedprice") / 2003).alias("truth"),
        F.col("l_quantity").alias("raw"),
        F.col("l_returnflag").alias("zone"),
        ((F.col("l_orderkey") % 30) + 1).cast("int").alias("seed_index"),
        F.when(F.col("l_linenumber") % 3 == 0, "test").otherwise("train").alias("split"),
    )


PAIRS_SQL = """
pairs AS (
  SELECT *, l_extendedprice / 2003 AS truth, l_quantity AS raw, l_returnflag AS zone,
         (l_orderkey % 30 + 1)::INTEGER AS seed_index,
         CASE WHEN l_linenumber % 3 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem)"""


def model_predictions(df: DataFrame) -> DataFrame:
    """Five stand-in models, one row per model."""
    p = {
        "cocal_only": F.col("raw"),
        "linear": F.col("raw") * 1.1 - 2.0,
        "random_forest": F.col("truth") * 0.7 + F.col("raw") * 0.3,
        "gradient_boosting": F.col("truth") * 0.7 + F.col("raw") * 0.3 + (F.col("l_linenumber") - 4) * 0.1,
        "mlp": F.col("raw") * 0.5 + 13.0,
    }
    choices = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("prediction")) for m, c in p.items()])
    return df.select("*", F.inline(choices))


MODEL_PREDICTIONS_SQL = (
    PAIRS_SQL
    + """,
model_predictions AS (
  SELECT *, 'cocal_only' AS model, raw AS prediction FROM pairs
  UNION ALL SELECT *, 'linear', raw * 1.1::DOUBLE - 2 FROM pairs
  UNION ALL SELECT *, 'random_forest', truth * 0.7::DOUBLE + raw * 0.3::DOUBLE FROM pairs
  UNION ALL SELECT *, 'gradient_boosting',
            truth * 0.7::DOUBLE + raw * 0.3::DOUBLE + (l_linenumber - 4) * 0.1::DOUBLE FROM pairs
  UNION ALL SELECT *, 'mlp', raw * 0.5::DOUBLE + 13 FROM pairs)"""
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long run scores: zone, model, seed_index, split, metric, score."""
    keys = ["zone", "model", "seed_index", "split"]
    wide = (
        model_predictions(pairs(spark, sf_dir))
        .groupBy(*keys)
        .agg(*metric_columns(F.col("truth"), F.col("prediction")))
    )
    return metrics_long(wide, keys)


SQL_METRICS = {
    "r2": "1 - avg(pow(truth - prediction, 2)) / var_pop(truth)",
    "mae": "avg(abs(truth - prediction))",
    "mse": "avg(pow(truth - prediction, 2))",
    "rmse": "sqrt(avg(pow(truth - prediction, 2)))",
}

SCORES_SQL = (
    MODEL_PREDICTIONS_SQL
    + """,
score_wide AS (
  SELECT zone, model, seed_index, split, """
    + ", ".join(f"{e} AS {m}" for m, e in SQL_METRICS.items())
    + """
  FROM model_predictions GROUP BY zone, model, seed_index, split),
scores AS ("""
    + " UNION ALL ".join(
        f"SELECT zone, model, seed_index, split, '{m}' AS metric, {m} AS score FROM score_wide" for m in SQL_METRICS
    )
    + ")"
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large samples: price per line, grouped by order priority."""
    li, o = lines(spark, sf_dir), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("method"), F.col("l_extendedprice").alias("value"),
        F.col("l_returnflag").alias("zone"),
    )


SAMPLES_SQL = """
samples AS (
  SELECT o_orderpriority AS method, l_extendedprice AS value, l_returnflag AS zone
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
