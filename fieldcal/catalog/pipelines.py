"""Queries of the build and scoring plans: feeds, joins, roll-ups, formulas, write-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcal.catalog.registry import (
    DENSE_SENSORS,
    EVENT_READINGS_SQL,
    LINEITEM_READINGS_SQL,
    PM10_PARAMETER,
    REF_LAT,
    REF_LON,
    STATION,
    STATION_ROWS_SQL,
    STATIONS_SQL,
    event_readings,
    lineitem_readings,
    query,
    rounded,
    sql_distance,
    sql_rounded,
    station_rows,
    stations,
    table,
)
from fieldcal.functions.calendar import calendar_block, floor_hour, parse_time
from fieldcal.functions.geo import haversine, mercator_lat, mercator_lon, mercator_x, mercator_y, within_radius
from fieldcal.functions.measure import device_type, dew_point, round_decimals, target_label_column
from fieldcal.models.formula import FAR, FAR_INTERCEPT, NEAR, apply_by_distance, far_model, near_model
from fieldcal.operators.hull import bounding_boxes, convex_hulls, shared_scale
from fieldcal.operators.metrics import rank_candidates, threshold_sweep
from fieldcal.operators.reshape import hourly_rollup, one_hot_levels, pivot_mean
from fieldcal.plans.integrate import integrate, mobile_feed, station_coordinates, station_feed, training_table
from fieldcal.plans.scoring import scoring_feed, scoring_table, write_back
from fieldcal.schema import SEASONS, TIMES_OF_DAY

_RADIUS = 2500.0
_ROLLED = ["LAT", "LON", "GPS_KMH", "GPS_DIR", "GPS_ALT", *DENSE_SENSORS]
_SOURCE = {
    "LAT": "lat", "LON": "lon", "GPS_KMH": "gps_kmh", "GPS_DIR": "gps_dir", "GPS_ALT": "gps_alt",
    **{s: f'"{s}"' for s in DENSE_SENSORS},
}
_STATS = {"MEAN": "avg", "MAX": "max", "MIN": "min"}
_REF = f"(SELECT lat FROM stations WHERE station = '{STATION}')", f"(SELECT lon FROM stations WHERE station = '{STATION}')"


def _calendar_sql(ts: str) -> str:
    return f"""
      lower(monthname({ts})) AS month, hour({ts})::INTEGER AS hour, lower(dayname({ts})) AS day_of_week,
      day({ts})::INTEGER AS day_of_month,
      'week' || least(4, (day({ts}) + 6) // 7) AS week_of_month,
      CASE WHEN month({ts}) IN (12, 1, 2) THEN 'winter' WHEN month({ts}) IN (3, 4, 5) THEN 'spring'
           WHEN month({ts}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
      CASE WHEN isodow({ts}) >= 6 THEN 'weekend' ELSE 'weekday' END AS weekend,
      CASE WHEN hour({ts}) BETWEEN 6 AND 11 THEN 'morning' WHEN hour({ts}) BETWEEN 12 AND 17 THEN 'afternoon'
           WHEN hour({ts}) >= 18 THEN 'evening' ELSE 'night' END AS time_of_day"""


_MOBILE_SQL = (
    LINEITEM_READINGS_SQL
    + f"""
, {STATIONS_SQL.strip()},
near_rows AS (
  SELECT * FROM dense_dew WHERE {sql_distance("lat", "lon", *_REF)} <= {_RADIUS}),
rolled AS (
  SELECT date_trunc('hour', ts) AS timestamp, device,
         avg(dew_point) AS dew_point, max(dew_point) AS "DEW_POINT_MAX", min(dew_point) AS "DEW_POINT_MIN",
         """
    + ", ".join(f'{f}({_SOURCE[v]}) AS "{v}_{s}"' for v in _ROLLED for s, f in _STATS.items())
    + """,
         count(dew_point) AS "NUM_MEASUREMENTS"
  FROM near_rows GROUP BY 1, 2),
mobile AS (
  SELECT *, CASE WHEN device = 'CAMO004' THEN 'static' ELSE 'dynamic' END AS device_type
  FROM rolled WHERE dew_point IS NOT NULL)"""
)
_ROLLED_COLUMNS = ["dew_point", "DEW_POINT_MAX", "DEW_POINT_MIN", *[f"{v}_{s}" for v in _ROLLED for s in _STATS]]
_OFFICIAL_SQL = (
    STATION_ROWS_SQL
    + f""",
official AS (
  SELECT local_ts - INTERVAL 1 HOUR AS timestamp, value AS "PM10_ARPA" FROM station_rows
  WHERE station = '{STATION}' AND parameter = '{PM10_PARAMETER}' AND value IS NOT NULL)"""
)
_TRAIN_COLUMNS = [c for c in _ROLLED_COLUMNS if not c.startswith("PM25")]


def _training_sql(target: str, where: str = "TRUE", kind: str = "device_type, ") -> str:
    return (
        f"WITH {_MOBILE_SQL}, {_OFFICIAL_SQL} SELECT DISTINCT timestamp, {kind}"
        f'{_calendar_sql("timestamp")}, "NUM_MEASUREMENTS", {sql_rounded(_TRAIN_COLUMNS)}, {target} '
        f"FROM mobile JOIN official USING (timestamp) WHERE {where}"
    )


@query(_training_sql('round("PM10_ARPA", 6) AS "PM10_ARPA"'))
def integrate_station_mobile(spark, sf_dir):
    table_ = integrate(
        stations(spark, sf_dir), station_rows(spark, sf_dir), lineitem_readings(spark, sf_dir), STATION,
        PM10_PARAMETER, _RADIUS, sensors=DENSE_SENSORS,
    )
    return rounded(table_)


@query(_training_sql('round("PM10_ARPA" - "PM10_MEAN", 6) AS delta', "device_type = 'dynamic'", ""))
def integrate_delta_dynamic(spark, sf_dir):
    built = integrate(
        stations(spark, sf_dir), station_rows(spark, sf_dir), lineitem_readings(spark, sf_dir), STATION,
        PM10_PARAMETER, _RADIUS, device_kind="dynamic", use_delta=True, sensors=DENSE_SENSORS,
    )
    return rounded(built)


@query(
    f"WITH {STATION_ROWS_SQL} SELECT local_ts - INTERVAL 1 HOUR AS timestamp, value AS \"PM25_ARPA\" FROM station_rows "
    f"WHERE station = '{STATION}' AND parameter = 'PM2.5' AND value IS NOT NULL"
)
def station_feed_clean(spark, sf_dir):
    return station_feed(station_rows(spark, sf_dir), STATION, "PM2.5")


@query(f'WITH {_MOBILE_SQL} SELECT timestamp, device_type, "NUM_MEASUREMENTS", {sql_rounded(_ROLLED_COLUMNS)} FROM mobile')
def mobile_feed_hours(spark, sf_dir):
    ref = station_coordinates(stations(spark, sf_dir), STATION)
    return rounded(mobile_feed(lineitem_readings(spark, sf_dir), ref, _RADIUS, sensors=DENSE_SENSORS))


@query(
    f"WITH {EVENT_READINGS_SQL} SELECT date_trunc('day', sec) AS day, device, "
    + ", ".join(
        f"round(avg(val) FILTER (sensor = '{s}'), 6) AS \"{s}\"" for s in ("BM_H", "BM_P", "BM_T", "PM10", "PM25")
    )
    + " FROM event_readings GROUP BY 1, 2 HAVING count(DISTINCT sensor) = 5"
)
def pivot_readings_mean(spark, sf_dir):
    rows = event_readings(spark, sf_dir).withColumn("time", parse_time(F.col("time")))
    rows = rows.withColumn("day", F.col("time").cast("date").cast("timestamp_ntz"))
    return rounded(pivot_mean(rows, ["day", "device"], "sensor", "val").dropna())


def _wide_events(spark, sf_dir):
    rows = event_readings(spark, sf_dir).withColumn("timestamp", parse_time(F.col("time")))
    return pivot_mean(rows, ["timestamp", "device", "lat", "lon"], "sensor", "val", DENSE_SENSORS)


_WIDE_EVENTS_SQL = (
    EVENT_READINGS_SQL
    + """,
wide AS (SELECT sec, device, lat, lon, avg(val) FILTER (sensor = 'PM10') AS pm10, avg(val) FILTER (sensor = 'PM25') AS pm25
         FROM event_readings GROUP BY ALL)"""
)


@query(
    f"""WITH {_WIDE_EVENTS_SQL}
    SELECT date_trunc('hour', sec) AS timestamp, device,
      round(avg(pm10), 6) AS "PM10_MEAN", round(max(pm10), 6) AS "PM10_MAX", round(min(pm10), 6) AS "PM10_MIN",
      round(avg(pm25), 6) AS "PM25_MEAN", round(max(pm25), 6) AS "PM25_MAX", round(min(pm25), 6) AS "PM25_MIN",
      count(pm10) AS "NUM_MEASUREMENTS" FROM wide GROUP BY 1, 2"""
)
def hourly_rollup_stats(spark, sf_dir):
    return rounded(hourly_rollup(_wide_events(spark, sf_dir), ["PM10", "PM25"], "PM10"))


@query(
    f"""WITH {_WIDE_EVENTS_SQL}
    SELECT date_trunc('hour', sec) AS timestamp, device, round(avg(lat), 6) AS "LAT_MEAN", round(avg(lon), 6) AS "LON_MEAN",
      round(avg(pm10), 6) AS "PM10_MEAN", count(pm10) AS "NUM_MEASUREMENTS" FROM wide GROUP BY 1, 2"""
)
def hourly_rollup_mean_count(spark, sf_dir):
    return rounded(hourly_rollup(_wide_events(spark, sf_dir), ["lat", "lon", "PM10"], "PM10", stats=("mean",)))


@query(
    f"""SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS timestamp,
        {_calendar_sql("(o_orderdate + to_hours(o_orderkey % 24))")} FROM orders"""
)
def calendar_features(spark, sf_dir):
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return calendar_block(table(spark, sf_dir, "orders").select("o_orderkey", at.alias("timestamp")))


@query("SELECT event_id, date_trunc('hour', ts) AS hour_start FROM events")
def hour_floor(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", floor_hour(F.col("ts")).alias("hour_start"))


@query(
    f"WITH {EVENT_READINGS_SQL} SELECT event_id, round({sql_distance('lat', 'lon', '45.6544', '13.789')}, 4) AS distance "
    f"FROM event_readings WHERE {sql_distance('lat', 'lon', '45.6544', '13.789')} <= {_RADIUS}"
)
def radius_filter(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    rows = event_readings(spark, sf_dir).where(within_radius(lat, lon, REF_LAT, REF_LON, _RADIUS))
    return rows.select("event_id", F.round(haversine(lat, lon, REF_LAT, REF_LON), 4).alias("distance"))


@query(
    """WITH r AS (SELECT event_id, value / 10 AS t, ((event_id % 105) - 4)::DOUBLE AS rh FROM events),
    g AS (SELECT event_id, 17.625::DOUBLE * t / (243.04::DOUBLE + t) + ln(CASE WHEN rh > 0 THEN rh / 100 END) AS g FROM r)
    SELECT event_id, round(243.04::DOUBLE * g / (17.625::DOUBLE - g), 6) AS dew_point FROM g"""
)
def dew_point_values(spark, sf_dir):
    rh = (F.col("event_id") % 105 - 4).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(dew_point(F.col("value") / 10, rh), 6).alias("dew_point")
    )


@query(
    f"""WITH {EVENT_READINGS_SQL},
    p AS (SELECT device, radians(lon) * 6378137 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y FROM event_readings),
    b AS (SELECT device, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
                 CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS dx,
                 CASE WHEN max(y) > min(y) THEN max(y) - min(y) ELSE 1 END AS dy FROM p GROUP BY device)
    SELECT device, round(x0 - dx * 0.05::DOUBLE, 4) AS x_min, round(x1 + dx * 0.05::DOUBLE, 4) AS x_max,
           round(y0 - dy * 0.05::DOUBLE, 4) AS y_min, round(y1 + dy * 0.05::DOUBLE, 4) AS y_max,
           round(dy / dx, 4) AS ratio FROM b"""
)
def web_mercator_bbox(spark, sf_dir):
    return rounded(bounding_boxes(event_readings(spark, sf_dir), "device", "lon", "lat"), 4)


@query(f"WITH {EVENT_READINGS_SQL} SELECT event_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM event_readings")
def web_mercator_round_trip(spark, sf_dir):
    lon = mercator_lon(mercator_x(F.col("lon")))
    lat = mercator_lat(mercator_y(F.col("lat")))
    return event_readings(spark, sf_dir).select("event_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(
    """WITH points AS (SELECT DISTINCT l_returnflag AS zone, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    ends AS (SELECT zone, x, max(y) AS hi, min(y) AS lo FROM points GROUP BY zone, x),
    upper AS (SELECT a.zone, a.x, a.hi AS y FROM ends a WHERE NOT EXISTS (
        SELECT 1 FROM ends b JOIN ends c ON b.zone = c.zone
        WHERE b.zone = a.zone AND b.x < a.x AND c.x > a.x
          AND b.hi + (c.hi - b.hi) * (a.x - b.x) / (c.x - b.x) >= a.hi)),
    lower_ AS (SELECT a.zone, a.x, a.lo AS y FROM ends a WHERE NOT EXISTS (
        SELECT 1 FROM ends b JOIN ends c ON b.zone = c.zone
        WHERE b.zone = a.zone AND b.x < a.x AND c.x > a.x
          AND b.lo + (c.lo - b.lo) * (a.x - b.x) / (c.x - b.x) <= a.lo))
    SELECT zone, x, y FROM upper UNION SELECT zone, x, y FROM lower_"""
)
def convex_hull(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("zone"), "l_quantity", "l_extendedprice")
    return convex_hulls(points, "zone", "l_quantity", "l_extendedprice").drop("corner")


@query(
    f"""WITH {STATIONS_SQL}, {EVENT_READINGS_SQL}
    SELECT event_id, s.address, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon
    FROM event_readings e JOIN stations s ON s.station = 'Supplier#' || lpad((e.event_id % 9)::VARCHAR, 9, '0')"""
)
def station_lookup(spark, sf_dir):
    named = event_readings(spark, sf_dir).select(
        "event_id", F.concat(F.lit("Supplier#"), F.lpad((F.col("event_id") % 9).cast("string"), 9, "0")).alias("station")
    )
    return rounded(named.join(stations(spark, sf_dir), "station").select("event_id", "address", "lat", "lon"))


@query(
    f"WITH {EVENT_READINGS_SQL} SELECT event_id, device, CASE WHEN device = 'CAMO004' THEN 'static' ELSE 'dynamic' END "
    "AS device_type FROM event_readings WHERE device <> 'CAMO004'"
)
def device_filter(spark, sf_dir):
    typed = event_readings(spark, sf_dir).select("event_id", "device", device_type(F.col("device")).alias("device_type"))
    return typed.where("device_type = 'dynamic'")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PM10_ARPA'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'PM25_ARPA' END AS label FROM orders"""
)
def parameter_label(spark, sf_dir):
    text = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), PM10_PARAMETER)
        .when(F.col("o_orderpriority") == "3-MEDIUM", "pm2.5")
        .otherwise("Biossido di azoto")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", target_label_column(text).alias("label"))


# ---------------------------------------------------------------- scoring

_SCORING_SQL = (
    LINEITEM_READINGS_SQL
    + f""",
scoring AS (
  SELECT DISTINCT ts AS timestamp, CASE WHEN device = 'CAMO004' THEN 'static' ELSE 'dynamic' END AS device_type,
    dew_point, lat, lon, device, gps_kmh, gps_dir, gps_alt, "BM_H", "BM_P", "BM_T", "PM10", "PM25",
    1 AS "NUM_MEASUREMENTS", {_calendar_sql("ts")}
  FROM dense_dew WHERE dew_point IS NOT NULL),
scored AS (
  SELECT *, {sql_distance("lat", "lon", "45.6544", "13.789")} AS distance,
    pow({NEAR["base"]}::DOUBLE, {NEAR["dew_slope"]!r}::DOUBLE * dew_point + {NEAR["dew_shift"]!r}::DOUBLE)
      * ({NEAR["pressure_slope"]!r}::DOUBLE * "BM_P" + {NEAR["pressure_shift"]!r}::DOUBLE)
      + abs({NEAR["pm10"]!r}::DOUBLE * "PM10" - abs({NEAR["inner_pressure"]!r}::DOUBLE * "BM_P"
        + {NEAR["inner_kmh"]!r}::DOUBLE * gps_kmh + {NEAR["inner_pm10"]!r}::DOUBLE * "PM10"
        + (season = 'autumn')::INTEGER + {NEAR["inner_shift"]!r}::DOUBLE) + {NEAR["outer_shift"]!r}::DOUBLE)
      + {NEAR["shift"]!r}::DOUBLE AS near,
    """
    + " + ".join(
        f"{c!r}::DOUBLE * "
        + (
            f"(season = '{n[7:]}')::INTEGER" if n.startswith("season_")
            else f"(time_of_day = '{n[12:]}')::INTEGER" if n.startswith("time_of_day_")
            else f'"{n}"'
        )
        for n, c in FAR.items()
    )
    + f""" + {FAR_INTERCEPT!r}::DOUBLE AS far
  FROM scoring)"""
)
_MAX_DISTANCE = 1500.0


def _scored(spark, sf_dir):
    features = scoring_table(lineitem_readings(spark, sf_dir), sensors=DENSE_SENSORS)
    return apply_by_distance(features, _MAX_DISTANCE)


@query(
    f"WITH {_SCORING_SQL} SELECT timestamp, device, round(lat, 6) AS lat, round(lon, 6) AS lon, round(distance, 4) AS distance, "
    f'round(CASE WHEN distance <= {_MAX_DISTANCE} THEN near ELSE far END, 6) AS "PM10_SR_EN" FROM scored'
)
def two_regime_scoring(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select(
        "timestamp", "device", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        F.round("distance", 4).alias("distance"), F.round("PM10_SR_EN", 6).alias("PM10_SR_EN"),
    )


_DUMMIES = [f"season_{s}" for s in SEASONS] + [f"time_of_day_{t}" for t in TIMES_OF_DAY]


@query(
    f"WITH {_SCORING_SQL} SELECT timestamp, device_type, month, hour, day_of_week, day_of_month, week_of_month, weekend, "
    'device, "NUM_MEASUREMENTS", '
    + sql_rounded(["dew_point", "lat", "lon", "gps_kmh", "gps_dir", "gps_alt", *DENSE_SENSORS])
    + ", "
    + ", ".join(f"(season = '{s}')::INTEGER AS season_{s}" for s in SEASONS)
    + ", "
    + ", ".join(f"(time_of_day = '{t}')::INTEGER AS time_of_day_{t}" for t in TIMES_OF_DAY)
    + " FROM scoring"
)
def scoring_features(spark, sf_dir):
    return rounded(scoring_table(lineitem_readings(spark, sf_dir), sensors=DENSE_SENSORS))


@query(
    f"""WITH {LINEITEM_READINGS_SQL},
    rolled AS (SELECT date_trunc('hour', ts) AS timestamp, device, avg(dew_point) AS dew_point, avg("PM10") AS "PM10",
                      avg("BM_P") AS "BM_P", avg(lat) AS lat, avg(lon) AS lon, count(dew_point) AS "NUM_MEASUREMENTS"
               FROM dense_dew GROUP BY 1, 2)
    SELECT timestamp, device, CASE WHEN device = 'CAMO004' THEN 'static' ELSE 'dynamic' END AS device_type,
           "NUM_MEASUREMENTS", {sql_rounded(["dew_point", "PM10", "BM_P", "lat", "lon"])}
    FROM rolled WHERE dew_point IS NOT NULL"""
)
def scoring_feed_hourly(spark, sf_dir):
    feed = scoring_feed(lineitem_readings(spark, sf_dir), aggregate=True, sensors=DENSE_SENSORS)
    return rounded(
        feed.select("timestamp", "device", "device_type", "NUM_MEASUREMENTS", "dew_point", "PM10", "BM_P", "lat", "lon")
    )


_WRITTEN = "time, round(lon, 6) AS lon, round(lat, 6) AS lat, device, sensor, round(val, 6) AS val, gps_kmh, gps_dir, gps_alt"
_PREDICTED_SQL = f"""
predicted AS (
  SELECT d.ts AS time, d.lon, d.lat, d.device, 'PM10_SR_EN' AS sensor,
         CASE WHEN s.distance <= {_MAX_DISTANCE} THEN s.near ELSE s.far END AS val, d.gps_kmh, d.gps_dir, d.gps_alt
  FROM dense d JOIN scored s ON d.ts = s.timestamp AND d.lat = s.lat AND d.lon = s.lon AND d.device = s.device)"""


@query(f"WITH {_SCORING_SQL}, {_PREDICTED_SQL} SELECT {_WRITTEN} FROM predicted")
def prediction_writeback(spark, sf_dir):
    readings = lineitem_readings(spark, sf_dir)
    return _positions_rounded(write_back(readings, _scored(spark, sf_dir), only_predictions=True))


@query(
    f"""WITH {_SCORING_SQL}, {_PREDICTED_SQL},
    long AS ("""
    + " UNION ALL ".join(
        f"SELECT ts AS time, lon, lat, device, '{s}' AS sensor, {v} AS val, gps_kmh, gps_dir, gps_alt FROM dense"
        for s, v in [*[(s, f'"{s}"') for s in DENSE_SENSORS], ("AN_CO2", "gps_kmh")]
    )
    + f" UNION ALL SELECT * FROM predicted) SELECT {_WRITTEN} FROM long"
)
def prediction_writeback_all(spark, sf_dir):
    readings = lineitem_readings(spark, sf_dir)
    return _positions_rounded(write_back(readings, _scored(spark, sf_dir)))


def _positions_rounded(df):
    return df.withColumns({c: round_decimals(F.col(c)) for c in ("lon", "lat", "val")})


_THRESHOLDS = [1000.0, 1500.0, 2000.0, 2500.0, 3000.0]
_SWEEP_METRICS = """round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
  round(avg(pow(y - p, 2)), 6) AS mse, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse"""


@query(
    f"""WITH {_SCORING_SQL},
    swept AS (SELECT t.threshold, s."PM10" AS y, CASE WHEN s.distance <= t.threshold THEN s.near ELSE s.far END AS p
              FROM scored s CROSS JOIN (VALUES {", ".join(f"({t}::DOUBLE)" for t in _THRESHOLDS)}) t(threshold))
    SELECT threshold, count(*) AS n, {_SWEEP_METRICS} FROM swept GROUP BY threshold"""
)
def threshold_sweep_scores(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumns({"near": near_model(), "far": far_model()})
    return rounded(threshold_sweep(s, "PM10", "distance", "near", "far", _THRESHOLDS))


_FORMULAS = {
    "identity": "raw", "halved": "raw / 2 + 12", "price_tax": "truth * (1 - l_tax) + l_discount", "squared": "raw * raw / 50",
}


@query(
    "WITH p AS (SELECT l_extendedprice / 2003 AS y, l_quantity AS raw, * FROM lineitem), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS candidate, y, {e.replace('truth', 'y')} AS p FROM p" for n, e in _FORMULAS.items()
    )
    + f"), s AS (SELECT candidate, {_SWEEP_METRICS} FROM c GROUP BY candidate) "
    "SELECT *, (row_number() OVER (ORDER BY rmse))::INTEGER AS place FROM s"
)
def formula_ranking(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns(
        {"truth": F.col("l_extendedprice") / 2003, "raw": F.col("l_quantity")}
    )
    return rounded(rank_candidates(df, "truth", {n: F.expr(e) for n, e in _FORMULAS.items()}))


@query(
    f"""WITH {EVENT_READINGS_SQL} SELECT round(min(least(val, gps_kmh, gps_alt)), 6) AS v_min,
        round(max(greatest(val, gps_kmh, gps_alt)), 6) AS v_max FROM event_readings"""
)
def map_shared_scale(spark, sf_dir):
    return rounded(shared_scale(event_readings(spark, sf_dir), ["val", "gps_kmh", "gps_alt"]))


@query(
    """SELECT o_orderkey, """
    + ", ".join(f"(s = '{s}')::INTEGER AS season_{s}" for s in SEASONS)
    + """ FROM (SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter'
         WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer'
         ELSE 'autumn' END AS s FROM orders)"""
)
def onehot_fixed_levels(spark, sf_dir):
    block = calendar_block(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("timestamp")))
    return one_hot_levels(block.select("o_orderkey", "season"), {"season": SEASONS})


@query(
    f"""WITH {_MOBILE_SQL}, {_OFFICIAL_SQL}
    SELECT timestamp, device_type, round("PM10_MEAN", 6) AS "PM10_MEAN", round("PM10_ARPA", 6) AS "PM10_ARPA"
    FROM mobile JOIN official USING (timestamp) WHERE device_type = 'static'"""
)
def static_device_join(spark, sf_dir):
    ref = station_coordinates(stations(spark, sf_dir), STATION)
    mobile = mobile_feed(lineitem_readings(spark, sf_dir), ref, _RADIUS, sensors=DENSE_SENSORS)
    official = station_feed(station_rows(spark, sf_dir), STATION, PM10_PARAMETER)
    built = training_table(mobile.where("device_type = 'static'"), official)
    return rounded(built.select("timestamp", "device_type", "PM10_MEAN", "PM10_ARPA"))
