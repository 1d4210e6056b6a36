"""Searches that prepare a fold once, shared passes of least squares families, models and metrics by name, records of reruns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from fieldcal.models import training
from fieldcal.models.elasticnet import FoldMoments
from fieldcal.models.glm import fit_glms
from fieldcal.models.training import CalibrationEstimator, CalibrationModel, random_search, register_model, train_and_score
from fieldcal.operators import metrics
from fieldcal.sources.results import flatten_results, nest_results, read_results, write_results


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b, s = rng.random() * 4, rng.random(), rng.choice(["low", "high"])
        rows.append((i, a, b, s, float(np.exp(0.3 * a - 0.5 * b + (0.4 if s == "high" else 0)) * (0.8 + 0.4 * rng.random()))))
    return spark.createDataFrame(rows, "k long, a double, b double, s string, y double").repartition(3).cache()


def estimator(model, **options):
    return CalibrationEstimator(model, "y", numeric=["a", "b"], categorical=["s"], raw="a", key=["k"], seed=5, **options)


@pytest.fixture(scope="module")
def ready(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = np.exp(x @ [0.3, -0.2, 0.0] + 0.5) * rng.uniform(0.7, 1.3, 300)
    return spark.createDataFrame([(Vectors.dense(r), float(v), i % 5) for i, (r, v) in enumerate(zip(x, y))], ["features", "label", "fold"]).repartition(3)


@pytest.mark.parametrize("family", ["gamma", "poisson"])
def test_regressions_of_many_settings_equal_single_fits(ready, family):
    settings = [{"regParam": r, "maxIter": m} for r in (0.0, 1e-2, 1.0) for m in (2, 50)]
    for s, fitted in zip(settings, fit_glms(ready, family, settings)):
        if s["maxIter"] > 2:  # rounds are counted differently
            one = GeneralizedLinearRegression(family=family, link="log", tol=1e-9, **s).fit(ready)
            assert fitted.line.coefficients == pytest.approx(list(one.coefficients), abs=1e-5)
            assert fitted.line.intercept == pytest.approx(one.intercept, abs=1e-5)
    assert fit_glms(ready, family, settings)[0].line.coefficients != fit_glms(ready, family, settings)[1].line.coefficients
    with pytest.raises(ValueError):
        fit_glms(ready, "binomial", settings)
    with pytest.raises(ValueError):
        fit_glms(ready.limit(0), family, settings)


def test_a_round_is_one_pass_whatever_the_settings(ready, monkeypatch):
    from fieldcal.models import glm

    passes = []
    real = glm.added
    monkeypatch.setattr(glm, "added", lambda parts: passes.append(1) or real(parts))
    fit_glms(ready, "gamma", [{"regParam": r, "maxIter": 4, "tol": 0.0} for r in (0.0, 0.1, 1.0, 10.0)])
    assert len(passes) == 4


def test_elastic_net_settings_share_one_pass(ready):
    moments = FoldMoments(ready)
    for share in (0.2, 1.0):
        fitted = moments.fit(share, 12)
        one = LinearRegression(regParam=fitted.penalty, elasticNetParam=share, standardization=False, tol=1e-12, maxIter=5000)
        one = one.fit(ready)
        assert fitted.coefficients == pytest.approx(list(one.coefficients), abs=2e-3)


@pytest.mark.parametrize("model,grid", [
    ("elasticnet", {"l1_ratio": [0.1, 1.0], "n_alphas": [5]}), ("gamma", {"regParam": [1e-4, 10.0], "maxIter": [20]}),
    ("decision_tree", {"maxDepth": [1, 4]}), ("knn", {"k": [3, 60]}),
])
def test_search_equals_fits_of_its_own(data, model, grid, monkeypatch):
    prepared = []
    real = CalibrationEstimator.prepare
    monkeypatch.setattr(CalibrationEstimator, "prepare", lambda self, *a, **k: prepared.append(1) or real(self, *a, **k))
    made = estimator(model, scaling="standard")
    best, tried = random_search(made, data, ["k"], n_iter=5, cv=3, seed=7, grid=grid)
    assert len(prepared) == 3 + 1  # once for each fold and once for the winner
    folded = training.contiguous_folds(data, ["k"], 3, 7).cache()
    for setting, error in tried:
        each = []
        for fold in range(3):
            fitted = made.copy({made.setting: setting}).fit(folded.where(f"fold <> {fold}"))
            each.append(metrics.regression_metrics(fitted.transform(folded.where(f"fold = {fold}")), "y", "prediction").first()["rmse"])
        assert error == pytest.approx(np.mean(each), rel=1e-6)
    errors = [e for _, e in tried]
    assert abs(errors[0] - errors[1]) > 1e-6 and best.transform(data).count() == data.count()


class _Mean:
    def __init__(self, value):
        self.value = value

    def transform(self, df):
        return df.withColumn("prediction", F.lit(self.value))


def test_models_and_metrics_by_name(data):
    register_model("shrunken_mean", lambda rows, setting, seed: _Mean(rows.agg(F.avg("label")).first()[0] * setting.get("share", 1.0)), {"share": [0.5, 1.0, 2.0]})
    metrics.register_metric("bias", lambda y, p: F.avg(p - y))
    try:
        best, tried = random_search(estimator("shrunken_mean"), data, ["k"], n_iter=9, cv=3)
        assert min(tried, key=lambda t: t[1])[0] == {"share": 1.0}
        zones = data.withColumn("zone", F.lit("m"))
        scores = train_and_score(zones, "m", estimator("shrunken_mean"), ["k"], 0.3, cv=3).collect()
        assert {r.split for r in scores} == {"train", "test"} and all(abs(r.bias) < 0.5 and abs(r.bias - r.bias_sum_back) < 1e-9 for r in scores)
        assert "bias" in metrics.metrics_long(metrics.regression_metrics(best.transform(data), "y", "prediction", ["s"]), ["s"]).toPandas().metric.tolist()
        for action in (lambda: register_model("linear", None), lambda: metrics.register_metric("r2", None)):
            with pytest.raises(ValueError):
                action()
    finally:
        training.GRIDS.pop("shrunken_mean"), training._REGISTERED.pop("shrunken_mean"), metrics.forget_metric("bias")
    assert metrics.METRICS == ["r2", "mae", "mse", "rmse"]


def test_a_registered_ml_model_is_stored_with_its_own_writer(spark, data, tmp_path):
    register_model("ridge", lambda rows, setting, seed: LinearRegression(regParam=0.1, **setting).fit(rows))
    try:
        fitted = estimator("ridge").fit(data)
        fitted.save(str(tmp_path / "m"), spark)
        again = CalibrationModel.load(str(tmp_path / "m"), spark)
        assert again.transform(data).agg(F.sum("prediction")).first() == fitted.transform(data).agg(F.sum("prediction")).first()
    finally:
        training.GRIDS.pop("ridge"), training._REGISTERED.pop("ridge")


def test_a_rerun_replaces_its_record(spark, tmp_path):
    zones = ["z1", "z2"]

    def write(run, seed, score):
        flat = spark.createDataFrame(
            [(run, seed, z, "r2", score, score, score, score) for z in zones],
            "run_id string, seed_index int, zone string, metric string, train_score double, test_score double, train_score_sum_cocal double, test_score_sum_cocal double",
        )
        records = nest_results(flat, zones, ["run_id", "seed_index"]).withColumn("scaling", F.lit("robust"))
        write_results(records, str(tmp_path), ["scaling"])

    for run, seed, score in (("p", 1, 0.1), ("p", 2, 0.2), ("p", 1, 0.9), ("q", 1, 0.4)):
        write(run, seed, score)
    found = read_results(spark, str(tmp_path), zones, multi_line=False)
    got = {(r.run_id, r.seed_index): r.score for r in flatten_results(found, zones).where("zone = 'z1' and kind = 'test_score'").collect()}
    assert got == {("p", 1): 0.9, ("p", 2): 0.2, ("q", 1): 0.4} and found.count() == 3
