"""One hand-made case per rule of the feeds, the calendar and the text functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldcal.functions.calendar import calendar_block, floor_hour, parse_time, parse_time_day_first, station_time_to_utc
from fieldcal.functions.geo import haversine, mercator_x, mercator_y, within_radius
from fieldcal.functions.measure import clip, decimal_comma, dew_point, target_label
from fieldcal.functions.text import (
    acronym,
    adler32,
    argument_line,
    is_valid_filename,
    model_label,
    parse_argument_line,
)
from fieldcal.operators.reshape import one_hot_levels, pivot_mean
from fieldcal.plans.integrate import integrate, mobile_feed, station_coordinates, station_feed
from fieldcal.plans.scoring import scoring_table, write_back
from fieldcal.models.formula import apply_by_distance
from fieldcal.schema import READING_SCHEMA, STATION_COLUMNS, nan_to_null

SENSORS = ["BM_H", "BM_P", "BM_T", "PM10", "PM25"]
REF = (45.6544, 13.789)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def readings(spark, rows):
    """rows: (time, device, {sensor: value}, lat, gps_kmh)"""
    long = [
        (time, 13.789, lat, device, sensor, float(value), kmh, 10.0, 5.0)
        for time, device, values, lat, kmh in rows
        for sensor, value in values.items()
    ]
    return spark.createDataFrame(long, READING_SCHEMA)


FULL = {"PM10": 10, "PM25": 6, "BM_T": 20, "BM_H": 50, "BM_P": 1000}


def test_station_time_is_one_hour_ahead_all_year(spark):
    for text, utc in [
        ("2023-07-01 00:30:00.0", dt.datetime(2023, 6, 30, 23, 30)),
        ("2023-01-01 00:30:00", dt.datetime(2022, 12, 31, 23, 30)),
        ("2024-03-10 03:30:00", dt.datetime(2024, 3, 10, 2, 30)),  # a clock change elsewhere must not matter
    ]:
        assert one(spark, station_time_to_utc(parse_time(F.lit(text)))) == utc


def test_fractions_are_cut_and_hours_floored(spark):
    assert one(spark, parse_time(F.lit("2024-01-01 10:59:59.999"))) == dt.datetime(2024, 1, 1, 10, 59, 59)
    assert one(spark, floor_hour(parse_time(F.lit("2024-03-10 02:59:59.9")))) == dt.datetime(2024, 3, 10, 2)
    assert one(spark, parse_time_day_first(F.lit("31/12/2023 23:00:00"))) == dt.datetime(2023, 12, 31, 23)
    assert one(spark, parse_time(F.lit("no time"))) is None


def test_decimal_comma_and_missing_marks(spark):
    assert one(spark, decimal_comma(F.lit("12,5"))) == 12.5
    assert one(spark, decimal_comma(F.lit("N/D"))) is None
    assert one(spark, decimal_comma(F.lit(""))) is None


def test_calendar_edges(spark):
    rows = [
        ("2024-02-07 05:59:59", "february", "wednesday", "week1", "winter", "weekday", "night"),
        ("2024-03-08 06:00:00", "march", "friday", "week2", "spring", "weekday", "morning"),
        ("2024-06-22 12:00:00", "june", "saturday", "week4", "summer", "weekend", "afternoon"),
        ("2024-11-21 18:00:00", "november", "thursday", "week3", "autumn", "weekday", "evening"),
        ("2024-12-31 00:00:00", "december", "tuesday", "week4", "winter", "weekday", "night"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(parse_time(F.col("t")).alias("timestamp"))
    got = calendar_block(df).orderBy("timestamp").collect()
    for g, r in zip(got, rows):
        assert (g.month, g.day_of_week, g.week_of_month, g.season, g.weekend, g.time_of_day) == r[1:]


def test_dew_point_is_null_without_humidity(spark):
    assert one(spark, dew_point(F.lit(20.0), F.lit(50.0))) == pytest.approx(9.26, abs=0.05)
    assert one(spark, dew_point(F.lit(20.0), F.lit(0.0))) is None
    assert one(spark, dew_point(F.lit(20.0), F.lit(-1.0))) is None


def test_radius_is_inclusive_and_pushed_to_the_scan(spark, tmp_path):
    d = one(spark, haversine(45.0, 13.0, 45.01, 13.0))
    assert d == pytest.approx(math.radians(0.01) * 6371000, rel=1e-9)
    points = spark.createDataFrame([(45.01, 13.0), (45.0100001, 13.0), (44.0, 13.0)], "lat double, lon double")
    assert points.where(within_radius(F.col("lat"), F.col("lon"), 45.0, 13.0, d)).count() == 1
    points.write.parquet(str(tmp_path / "p"))
    near = spark.read.parquet(str(tmp_path / "p")).where(within_radius(F.col("lat"), F.col("lon"), 45.0, 13.0, 2000.0))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(lat" in plan
    # around a pole and over the date line the rectangle stays open
    far = spark.createDataFrame([(89.9999, 170.0), (0.0, 179.9999)], "lat double, lon double")
    assert far.where(within_radius(F.col("lat"), F.col("lon"), 90.0, 0.0, 1000.0)).count() == 1
    assert far.where(within_radius(F.col("lat"), F.col("lon"), 0.0, -179.9999, 1000.0)).count() == 1


def test_web_mercator_known_point(spark):
    assert one(spark, mercator_x(F.lit(180.0))) == pytest.approx(20037508.342789244)
    assert one(spark, mercator_y(F.lit(45.0))) == pytest.approx(5621521.486192066)


def test_pivot_drops_null_keys_and_averages_repeats(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 5.0), (None, "x", 9.0), ("b", "x", 2.0)], "k string, s string, v double"
    )
    got = {r.k: (r.x, r.y) for r in pivot_mean(df, ["k"], "s", "v").collect()}
    assert got == {"a": (2.0, 5.0), "b": (2.0, None)}


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, y string"))
    assert df.agg(F.avg("x"), F.count("x")).first()[:] == (1.0, 1)


def test_mobile_feed_rules(spark):
    rows = [
        ("2024-01-01 10:00:00.9", "CAMO001", FULL, 45.6544, 1.0),
        ("2024-01-01 10:59:59.1", "CAMO001", {**FULL, "PM10": 20, "BM_H": 0}, 45.6544, 1.0),
        ("2024-01-01 10:30:00", "CAMO001", {k: v for k, v in FULL.items() if k != "BM_P"}, 45.6544, 1.0),
        ("2024-01-01 10:10:00", "CAMO004", {**FULL, "AN_CO2": 7}, 45.6544, 1.0),
        ("2024-01-01 10:20:00", "CAMO001", FULL, 45.6544, None),
        ("2024-01-01 10:40:00", "CAMO001", FULL, 46.0, 1.0),
    ]
    got = {r.device_type: r for r in mobile_feed(readings(spark, rows), REF, 500.0, sensors=SENSORS).collect()}
    assert set(got) == {"static", "dynamic"}
    moving = got["dynamic"]
    assert moving.timestamp == dt.datetime(2024, 1, 1, 10)
    assert (moving.PM10_MEAN, moving.PM10_MAX, moving.PM10_MIN) == (15.0, 20.0, 10.0)
    assert moving.NUM_MEASUREMENTS == 1  # the row without humidity has no dew point and does not count
    only = mobile_feed(readings(spark, rows), REF, 500.0, "static", SENSORS)
    assert only.count() == 1 and "device_type" not in only.columns


def station_rows(spark):
    rows = [
        ("2024-01-01 11:00:00.0", "S1", "Particelle sospese PM10", "30,5", "u", "v"),
        ("2024-01-01 12:00:00.0", "S1", "Particelle sospese PM10", "N/D", "u", "v"),
        ("2024-01-01 11:00:00.0", "S2", "Particelle sospese PM10", "99", "u", "v"),
        ("2024-01-01 11:00:00.0", "S1", "PM2.5", "12.25", "u", "v"),
    ]
    return spark.createDataFrame(rows, STATION_COLUMNS)


def test_integrate_end_to_end(spark):
    stations = spark.createDataFrame([("S1", REF[1], REF[0], "x")], "station string, lon double, lat double, address string")
    rows = [
        ("2024-01-01 10:05:00", "CAMO001", FULL, 45.6544, 1.0),
        ("2024-01-01 10:05:00", "CAMO002", FULL, 45.6544, 1.0),  # the same row once the device is gone
        ("2024-01-01 11:05:00", "CAMO001", FULL, 45.6544, 1.0),
    ]
    table = integrate(stations, station_rows(spark), readings(spark, rows), "S1", "Particelle sospese PM10", 500.0, sensors=SENSORS)
    got = table.collect()
    assert len(got) == 1
    assert table.columns[:8] == ["month", "hour", "day_of_week", "day_of_month", "week_of_month", "season", "weekend", "time_of_day"]
    assert table.columns[-2:] == ["PM10_MEAN", "PM10_ARPA"] and not [c for c in table.columns if c.startswith("PM25")]
    assert got[0].PM10_ARPA == 30.5
    delta = integrate(stations, station_rows(spark), readings(spark, rows), "S1", "PM2.5", 500.0, use_delta=True, sensors=SENSORS)
    assert delta.columns[-2:] == ["PM25_MEAN", "delta"] and delta.first().delta == 12.25 - 6.0
    with pytest.raises(ValueError):
        station_coordinates(stations, "unknown")
    with pytest.raises(ValueError):
        station_feed(station_rows(spark), "S1", "NO2")


def test_scoring_and_write_back(spark):
    rows = [
        ("2024-01-01 10:05:00.5", "CAMO001", FULL, 45.6544, 1.0),
        ("2024-01-01 10:05:00.5", "CAMO001", FULL, 45.6544, 2.0),  # same place and time, other speed
        ("2024-01-01 10:06:00", "CAMO002", FULL, 45.70, 1.0),
    ]
    long = readings(spark, rows)
    features = scoring_table(long, sensors=SENSORS)
    assert [r.NUM_MEASUREMENTS for r in features.select("NUM_MEASUREMENTS").distinct().collect()] == [1]
    scored = apply_by_distance(features, 1000.0)
    far = scored.where("distance > 1000").first()
    expected = (
        0.21922735688784111 * 1000 + 0.02326372850401895 * 5 - 0.0028953559222595437 * 10 - 0.074144178352954233
        - 0.1716236221740934 + 0.80541566340406936 * 10 + 0.51015088847029162 * far.dew_point + 0.6006034360228186
        + 0.004663331919003846 - 217.23136634033793
    )
    assert far.PM10_SR_EN == pytest.approx(expected, abs=1e-9)
    only = write_back(long, scored, only_predictions=True).collect()
    assert len(only) == 5  # two speeds at one place and time give 2 x 2 rows, the far device one
    assert {r.sensor for r in only} == {"PM10_SR_EN"}
    every = write_back(long, scored).collect()
    assert len(every) == 15 + 5 and [r.time for r in every] == sorted(r.time for r in every)
    near_edge = scored.where("distance <= 1000").select(F.max("distance")).first()[0]
    assert apply_by_distance(features, near_edge).where("distance <= {}".format(near_edge)).count() == 2
    with pytest.raises(ValueError):
        apply_by_distance(features, -1.0)


def test_text_functions(spark):
    assert one(spark, acronym(F.lit("mainzone 2025"), 6)) == "MN2025"
    assert one(spark, acronym(F.lit("a1234"), 3)) is None
    assert one(spark, adler32(F.lit("Wikipedia"))) == 300286872
    assert one(spark, adler32(F.lit(""))) == 1
    assert one(spark, model_label(F.lit("cocal_only"))) == "COCAL Only"
    assert one(spark, model_label(F.lit("svr"))) == "SVR"
    assert one(spark, is_valid_filename(F.lit("com1.txt"))) is False
    assert one(spark, is_valid_filename(F.lit("x" * 256))) is False
    assert one(spark, is_valid_filename(F.lit("run_1"))) is True
    line = argument_line(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert one(spark, line) == "a;1;b;2"
    assert one(spark, parse_argument_line(F.lit("a;1;b;2"))) == {"a": "1", "b": "2"}
    assert one(spark, clip(F.lit(1e20))) == 1e15
    assert target_label("Particelle sospese PM10") == "PM10_ARPA" and target_label("pm2.5") == "PM25_ARPA"


def test_unknown_levels_are_all_zeros(spark):
    df = one_hot_levels(spark.createDataFrame([("x",), ("a",), (None,)], "c string"), {"c": ["a", "b"]})
    assert sorted(r[:] for r in df.collect()) == [(0, 0), (0, 0), (1, 0)]
