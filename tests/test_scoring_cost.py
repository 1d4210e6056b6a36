"""Scoring and write-back: what they cost a row, and that the cheaper way gives the same rows."""

import math
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions.measure import round_decimals
from fieldcal.models.formula import apply_by_distance
from fieldcal.operators.ordering import sorted_by_time
from fieldcal.plans.scoring import scoring_table
from fieldcal.schema import READING_COLUMNS, READING_SCHEMA

SENSORS = ["BM_H", "BM_P", "BM_T", "PM10", "PM25"]
#: HotSpot leaves methods of more bytes to the interpreter.
HUGE_METHOD = 8000


def _readings(spark, rows):
    long = [
        (time, 13.79, 45.66, device, s, v, 1.0, 2.0, 3.0) for time, device, values in rows for s, v in values.items()
    ]
    return spark.createDataFrame(long, READING_SCHEMA).select(*READING_COLUMNS)


def test_scoring_compiles(spark, capsys, tmp_path):
    path = str(tmp_path / "readings")  # columns from a file are not folded into constants
    _readings(spark, [("2024-01-01 10:00:00", "CAMO001", dict.fromkeys(SENSORS, 20.0))]).write.parquet(path)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        apply_by_distance(scoring_table(spark.read.parquet(path), sensors=SENSORS), 1000.0).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < HUGE_METHOD


def test_scoring_still_drops_incomplete_rows(spark):
    full = dict.fromkeys(SENSORS, 20.0)
    rows = [
        ("2024-01-01 10:00:00", "CAMO001", full),
        ("2024-01-01 10:00:01", "CAMO001", {**full, "PM25": None}),
        ("2024-01-01 10:00:02", "CAMO001", {**full, "BM_H": 0.0}),  # no dew point
        ("2024-01-01 25:00:00", "CAMO001", full),
        ("2024-01-01 10:00:03", None, full),
    ]
    official = spark.createDataFrame([("2024-01-01 10:00:00", None), ("2024-01-01 10:00:09", 1.0)], "timestamp string, PM10_ARPA double")
    official = official.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = scoring_table(_readings(spark, rows), sensors=SENSORS)
    assert [str(r.timestamp) for r in got.collect()] == ["2024-01-01 10:00:00"]
    assert not any(v is None for v in got.first())
    assert scoring_table(_readings(spark, rows), official, sensors=SENSORS).count() == 0  # its official value is missing


def test_round_decimals_is_round(spark):
    draw = random.Random(7)
    values = [0.0, -0.0, 5e-7, -5e-7, 4.9999999e-7, 1.0000005, 2.5, 1e6, 999999.9999995, 1e15, -1e300, 5e-324, math.inf, -math.inf, math.nan, None]
    values += [n / 1e6 + s * 5e-7 for n in (0, 1, 7, 45654400, 13789000, 999999999999) for s in (-1, 0, 1)]
    values += [math.nextafter(v, w) for v in (1.0000005, 0.1234565, 45.6544005) for w in (-math.inf, math.inf)]
    values += [draw.choice((-1, 1)) * draw.uniform(0, 10.0 ** draw.randint(-8, 9)) for _ in range(50_000)]
    values += [round(draw.uniform(-100, 100), 7) for _ in range(50_000)]  # many end in a five
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", T.DoubleType())]))
    for digits in (2, 6):
        bits = [c.cast("string") for c in (F.round("x", digits), round_decimals(F.col("x"), digits))]
        assert df.where(~bits[0].eqNullSafe(bits[1])).limit(3).collect() == []



def test_sorted_by_time_is_order_by(spark):
    spread = spark.range(20_000).select(
        F.expr("timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 7919 % 20000 as decimal(18,6)))").alias("time"),
        (F.col("id") % 5).cast("string").alias("device"), "id",
    )  # the tests' zone skips an hour on that day
    odd = spark.sql("SELECT * FROM VALUES (cast(NULL AS timestamp_ntz), 'a', -1L), (timestamp_ntz'1960-01-01 00:00:00.5', 'b', -2L), "
                    "(timestamp_ntz'2100-01-01 00:00:00', 'c', -3L) t(time, device, id)")
    df = spread.union(odd)
    expected = [r[:] for r in df.orderBy("time", "device", "id").collect()]
    got = sorted_by_time(df, ["time", "device", "id"], spread.select("time"), share=1.0)
    assert [r[:] for r in got.collect()] == expected
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 7_000
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan(got)
    hot = df.withColumn("time", F.when(F.col("id") % 10 == 0, F.col("time")).otherwise(F.expr("timestamp_ntz'2024-03-10 01:00:00'")))
    again = sorted_by_time(hot, ["time", "device", "id"], hot.select("time"), share=1.0)
    assert "rangepartitioning" in plan(again)  # one second holds most rows: the further columns split it
    assert [r.id for r in again.collect()] == [r.id for r in hot.orderBy("time", "device", "id").collect()]
