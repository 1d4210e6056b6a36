"""Inputs beyond any fixed number of columns, samples or levels, and values that must not count."""

import gzip
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldcal.functions.tails import _small_u_tail
from fieldcal.models.baseline import offsets_with_total
from fieldcal.models.elasticnet import fit_elasticnet_cv
from fieldcal.models.training import CalibrationEstimator
from fieldcal.operators.eda import density_by_category
from fieldcal.operators.ordering import exact_split
from fieldcal.operators.quantiles import exact_quantiles
from fieldcal.operators.ranktests import _range_parts, fisher_2x2, kruskal_wallis, mann_whitney_pairs, wilcoxon_signed_rank
from fieldcal.operators.reshape import pivot_mean
from fieldcal.plans.scoring import score_file
from fieldcal.sources.files import merged_readings, read_readings


def test_elastic_net_with_300_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 300))
    y = 3 * x[:, 7] - 2 * x[:, 250] + 0.01 * rng.normal(size=400)
    df = spark.createDataFrame([(Vectors.dense(a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))], ["features", "label", "fold"])
    fit = fit_elasticnet_cv(df, n_alphas=10, l1_ratio=0.9)
    assert len(fit.coefficients) == 300
    assert fit.coefficients[7] == pytest.approx(3, abs=0.05) and fit.coefficients[250] == pytest.approx(-2, abs=0.05)


def test_rank_tests_with_80_samples(spark):
    rows = [(f"m{m:02d}", float((i * 37 + m * 11) % 101 + m)) for m in range(80) for i in range(5)]
    df = spark.createDataFrame(rows, "method string, value double")
    pairs = {(r.method, r.other): r for r in mann_whitney_pairs(df, "value", "method").collect()}
    assert len(pairs) == 80 * 79
    for a, b in (("m00", "m79"), ("m40", "m41"), ("m13", "m02")):
        x, y = ([v for m, v in rows if m == name] for name in (a, b))
        assert pairs[a, b].u1 == sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    values = np.array([v for _, v in rows])
    ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    n = len(rows)
    sums = [ranks[5 * m : 5 * m + 5].sum() for m in range(80)]
    h = 12 / (n * (n + 1)) * sum(s * s / 5 for s in sums) - 3 * (n + 1)
    _, t = np.unique(values, return_counts=True)
    assert kruskal_wallis(df, "value", "method").first().h == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))


def test_small_side_is_exact_whatever_the_other_side(spark):
    rows = [("a", float(x) + 0.5) for x in (1, 40_000, 90_000)] + [("b", float(x)) for x in range(100_000)]
    df = spark.createDataFrame(rows, "method string, value double")
    row = mann_whitney_pairs(df, "value", "method").where("method = 'a'").first()
    assert row.p_value == pytest.approx(min(1.0, 2 * _small_u_tail(3, 100_000, row.u)))


def test_signed_rank_with_zeros_takes_the_normal_form(spark):
    values = [1.5, 2.7, 3.1, -0.4, 5.9, 0.0, 0.0, 0.0, 7.3, -2.2]
    df = spark.createDataFrame([(v, 0.0) for v in values], "a double, b double")
    row = wilcoxon_signed_rank(df, "a", "b").first()
    assert (row.n, row.t_plus) == (7, 24.0) and row.p_value == pytest.approx(math.erfc(1.6903085 / math.sqrt(2)), abs=1e-6)
    assert wilcoxon_signed_rank(df.where("a = 0"), "a", "b").collect() == []


def test_fisher_on_an_empty_group(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 2, 3, 4)], "s_a long, f_a long, s_b long, f_b long")
    p = [r.p_value for r in fisher_2x2(df).orderBy(F.col("s_a").asc_nulls_first()).collect()]
    assert p[0] is None and p[1] == pytest.approx(1.0)


def test_pivot_with_300_sensors(spark):
    df = spark.range(600).select((F.col("id") % 2).alias("k"), F.concat(F.lit("s"), F.col("id") % 300).alias("sensor"), F.col("id").cast("double").alias("v"))
    assert len(pivot_mean(df, ["k"], "sensor", "v").columns) == 301


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),)] * 3, "x double")
    row = exact_quantiles(df, "x", {"median": 0.5}).first()
    assert (row.n, row["median"]) == (10, 4.5)
    wide = pivot_mean(df.withColumn("k", F.lit(1)).withColumn("s", F.lit("a")), ["k"], "s", "x").first()
    assert wide.a == 4.5


def test_equal_keys_on_both_sides_of_a_cut_are_an_error(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"))
    with pytest.raises(ValueError, match="equal keys"):
        exact_split(df, ["k"], 0.3, 1).collect()


def test_density_keeps_every_grid_point(spark):
    values = [float(i % 10) for i in range(999)] + [1000.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "c string, v double")
    rows = density_by_category(df, "c", "v").orderBy("grid").collect()
    assert [r.grid for r in rows] == list(range(200)) and {r.c for r in rows} == {"a"}
    x = np.array(values)
    h = x.std(ddof=1) * 1000**-0.2
    for r in (rows[0], rows[100], rows[199]):
        assert r.density == pytest.approx(np.exp(-(((r.x - x) / h) ** 2) / 2).sum() / (1000 * h * math.sqrt(2 * math.pi)), abs=1e-12)


_CSV = "time,lon,lat,device,sensor,val,gps_kmh,gps_dir,gps_alt\n2024-01-01 10:00:00,13.7,45.6,CAMO001,PM10,3.5,0,0,0\n"


def test_any_file_name_and_compression(spark, tmp_path):
    (tmp_path / "r.txt").write_text(_CSV)
    (tmp_path / "r.csv.gz").write_bytes(gzip.compress(_CSV.encode()))
    assert read_readings(spark, str(tmp_path / "r.txt")).count() == 1
    assert read_readings(spark, str(tmp_path / "r.csv.gz")).count() == 1
    with pytest.raises(ValueError, match="no CSV rows"):
        merged_readings(spark, str(tmp_path))
    (tmp_path / "empty.csv").write_text(_CSV.splitlines()[0] + "\n")
    with pytest.raises(ValueError, match="no CSV rows"):
        score_file(spark, str(tmp_path / "empty.csv"), str(tmp_path / "out"), 1.0)


def test_bagged_trees_grow_until_their_leaves_are_pure(spark):
    """Every row of a tree's draw has a leaf of its own, however deep."""
    rows = spark.createDataFrame([(i, float(i), float(i * i % 37)) for i in range(64)], "k long, x double, y double")
    fitted = CalibrationEstimator("bagging", "y", numeric=["x"], key=["k"], numTrees=2).fit(rows).fitted
    assert all(sum(left == 0 for left in tree.left) > 20 for tree in fitted.trees)


def test_group_and_total_medians_take_two_scans(spark):
    """Groups and total come from the same two scans; rows of a null group count only for the total."""
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][i % 3], i % 4 if i % 7 else None, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "g string, h int, y double, x double"
    train = spark.createDataFrame(rows, schema).mapInArrow(counting, schema)
    offsets, total = offsets_with_total(train, "y", "x", ["g", "h"])
    got = {(r.g, r.h): r.offset for r in offsets.collect()}
    deltas = {}
    for g, h, y, x in rows:
        if g is not None and h is not None:
            deltas.setdefault((g, h), []).append(y - x)
    assert got == pytest.approx({key: float(np.median(d)) for key, d in deltas.items()})
    assert total == pytest.approx(float(np.median([y - x for _, _, y, x in rows])))
    assert read.value == 2 * len(rows)


def test_group_medians_without_rows(spark):
    offsets, total = offsets_with_total(spark.createDataFrame([], "g string, y double, x double"), "y", "x", ["g"])
    assert offsets.count() == 0 and total is None


def test_rank_sums_do_not_depend_on_batches():
    """A test cut into many batches, and many tests in a batch, give the sums of whole ranges."""
    rng = np.random.default_rng(6)
    keys = ["a"] * 7 + ["b"] + ["c"] * 12
    counts = rng.integers(0, 4, size=(len(keys), 3)).astype(float)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), 3).cast(pa.list_(pa.float64()))
    whole = pa.RecordBatch.from_arrays(
        [pa.array([4] * len(keys), pa.int32()), pa.array(keys), pa.array(np.arange(len(keys), dtype=float)), flat], ["_part", "key", "_v", "c"]
    )

    def sums(size):
        pieces = [whole.slice(i, size) for i in range(0, len(keys), size)]
        return pa.Table.from_batches(list(_range_parts(iter([whole.slice(0, 0), *pieces]), 3, 1))).to_pylist()

    expected = sums(len(keys))
    assert [r["key"] for r in expected] == ["a", "b", "c"]
    for size in (1, 2, 5, 8):
        assert sums(size) == expected
    for r in expected:
        c = counts[[k == r["key"] for k in keys]]
        values = [np.repeat(np.arange(len(c)), c[:, i].astype(int)) for i in range(3)]
        above = [float(sum((x > y) + 0.5 * (x == y) for x in values[i] for y in values[j])) for i in range(3) for j in range(3)]
        assert r["l"] == above and r["s"] == c.sum(axis=0).tolist()
        assert r["t"] == float((c.sum(axis=1) ** 3 - c.sum(axis=1)).sum())
    assert list(_range_parts(iter([whole.slice(0, 0)]), 3, 1)) == []
