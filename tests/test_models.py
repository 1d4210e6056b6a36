"""Models: closed forms, exact neighbours, determinism over partitions, persistence."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldcal.models.elasticnet import fit_elasticnet_cv
from fieldcal.models.knn import fit_knn
from fieldcal.models.training import (
    GRIDS,
    CalibrationEstimator,
    CalibrationModel,
    draw_settings,
    random_search,
    train_and_score,
)
from fieldcal.operators.metrics import regression_metrics
from fieldcal.plans.analysis import ensemble_of_models


def rows(n=300, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s, x, raw = rng.choice(["summer", "winter"]), rng.gauss(5, 2), rng.gauss(20, 4)
        out.append((i, s, rng.choice(["day", "night"]), x, raw, abs(raw * 0.8 + x * 1.5 + (3 if s == "summer" else 0) + rng.gauss(0, 0.5)) + 1, "m"))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "k long, season string, part string, x double, raw double, y double, zone string").repartition(5).cache()


def estimator(model, **options):
    return CalibrationEstimator(
        model, "y", numeric=["x", "raw"], categorical=["season"], raw="raw", groups=["season", "part"], key=["k"], seed=3, **options
    )


SETTINGS = {
    "linear": {}, "gamma": {"regParam": 1e-4, "maxIter": 20}, "poisson": {"regParam": 1e-4, "maxIter": 20},
    "sgd": {"loss": "huber", "regParam": 1e-4, "elasticNetParam": 0.5}, "elasticnet": {"l1_ratio": 0.5, "n_alphas": 20},
    "random_forest": {"numTrees": 5, "maxDepth": 5, "min_leaf": 2}, "bagging": {"numTrees": 5, "maxDepth": 5},
    "gradient_boosting": {"maxIter": 5, "maxDepth": 3, "min_leaf": 0.01, "stepSize": 0.3},
    "adaboost": {"n_estimators": 7, "loss": "square"}, "knn": {"k": 3, "weights": "distance"}, "decision_tree": {"maxDepth": 5},
    "cocal_only": {}, "basic_median": {}, "basic_median_plain_delta": {}, "basic_median_delta": {},
}


@pytest.mark.parametrize("model", sorted(GRIDS))
def test_every_model_fits_predicts_and_survives_storage(spark, data, model, tmp_path):
    fitted = estimator(model, scaling="robust", **SETTINGS[model]).fit(data)
    scored = fitted.transform(data)
    assert scored.columns == data.columns + ["prediction"]
    assert scored.select("x", "raw").exceptAll(data.select("x", "raw")).count() == 0  # inputs come back unscaled
    quality = regression_metrics(scored, "y", "prediction").first()
    assert quality.n == 300 and quality.r2 is not None
    if model not in ("cocal_only", "basic_median", "basic_median_plain_delta", "basic_median_delta"):
        assert quality.r2 > 0.5
    fitted.save(str(tmp_path / "m"), spark)
    again = CalibrationModel.load(str(tmp_path / "m"), spark).transform(data)
    both = scored.select("k", F.col("prediction").alias("a")).join(again.select("k", "prediction"), "k")
    assert both.where(F.abs(F.col("a") - F.col("prediction")) > 1e-9).count() == 0


def test_grouped_baseline_uses_the_global_median_for_unseen_groups(spark, data):
    train = data.where("not (season = 'summer' and part = 'night')")
    fitted = estimator("basic_median_delta").fit(train)
    delta = np.median([r.y - r.raw for r in train.collect()])
    unseen = fitted.transform(data.where("season = 'summer' and part = 'night'")).collect()
    assert unseen and all(r.prediction == pytest.approx(r.raw + delta) for r in unseen)


def test_linear_fit_equals_normal_equations(data):
    got = data.collect()
    x = np.array([[r.season == "summer", r.season == "winter", r.x, r.raw] for r in got], dtype=float)
    beta, *_ = np.linalg.lstsq(x, np.array([r.y for r in got]), rcond=None)
    for scaling in ("none", "standard", "minmax", "robust"):
        scored = estimator("linear", scaling=scaling).fit(data).transform(data).orderBy("k").collect()
        expected = {r.k: row @ beta for r, row in zip(got, x)}
        assert max(abs(r.prediction - expected[r.k]) for r in scored) < 1e-5


def test_log_target_with_rescaling(data):
    got = data.collect()
    scored = estimator("linear", log_scale_target=True, linear_scaling=True).fit(data).transform(data).collect()
    x = np.array([[r.season == "summer", r.season == "winter", r.x, r.raw] for r in got], dtype=float)
    z = np.log1p(np.array([r.y for r in got]))
    p = x @ np.linalg.lstsq(x, z, rcond=None)[0]
    slope = np.cov(z, p)[0, 1] / (np.var(p) + 1e-12)
    expected = dict(zip([r.k for r in got], np.expm1(slope * p + z.mean() - slope * p.mean())))
    assert max(abs(r.prediction - expected[r.k]) for r in scored) < 1e-4


def test_elasticnet_path_equals_direct_descent(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1, 5, 1, 2] + 3
    y = x @ [1.0, 0.0, -2.0, 0.3] + rng.normal(size=200) * 0.5 + 100
    fold = np.arange(200) % 5
    cells = [(Vectors.dense(a), float(b), int(f)) for a, b, f in zip(x, y, fold)]
    df = spark.createDataFrame(cells, ["features", "label", "fold"])
    fit = fit_elasticnet_cv(df, l1_ratio=0.7, n_alphas=15)

    def descend(x, y, alpha):
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.zeros(4)
        for _ in range(5000):
            for j in range(4):
                rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
                w[j] = np.sign(rho) * max(abs(rho) - alpha * 0.7, 0) / ((xc[:, j] ** 2).mean() + alpha * 0.3)
        return w, y.mean() - w @ x.mean(0)

    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / (200 * 0.7)
    alphas = top * np.power(1e-3, np.arange(15) / 14)
    assert min(abs(alphas - fit.penalty)) < 1e-9
    w, b = descend(x, y, fit.penalty)
    assert fit.coefficients == pytest.approx(list(w), abs=1e-6) and fit.intercept == pytest.approx(b, abs=1e-5)

    def cv_error(alpha):
        total = 0
        for f in range(5):
            w, b = descend(x[fold != f], y[fold != f], alpha)
            total += np.mean((y[fold == f] - x[fold == f] @ w - b) ** 2)
        return total

    at = int(np.argmin(abs(alphas - fit.penalty)))
    around = [alphas[i] for i in (at - 1, at, at + 1) if 0 <= i < 15]
    assert min(around, key=cv_error) == alphas[at]


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_equal_brute_force(spark, weights):
    rng = random.Random(8)
    train = [((float(rng.randint(0, 20)), float(rng.randint(0, 20))), float(rng.randint(0, 99))) for _ in range(400)]
    train += [((5.0, 5.0), 50.0)] * 200  # a third of the rows are copies
    queries = [(i, (rng.random() * 22, rng.random() * 22)) for i in range(80)] + [(80 + i, (5.0, 5.0)) for i in range(20)]
    t = spark.createDataFrame([(Vectors.dense(x), y) for x, y in train], ["features", "label"]).repartition(4)
    q = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in queries], ["i", "features"]).repartition(3)
    expected = {}
    for i, x in queries:
        near = sorted((np.hypot(x[0] - a[0], x[1] - a[1]), y) for a, y in train)[:5]
        if weights == "uniform":
            expected[i] = np.mean([y for _, y in near])
        elif any(d == 0 for d, _ in near):
            expected[i] = np.mean([y for d, y in near if d == 0])
        else:
            expected[i] = sum(y / d for d, y in near) / sum(1 / d for d, _ in near)
    # columns of any name pass through
    q = q.select("i", "features", *[F.lit(7).alias(c) for c in ("x", "y", "d", "cell", "row", "vote")])
    for options in ({}, {"most_pivots": 1}, {"most_pivots": 7, "block_rows": 30}):
        got = fit_knn(t, k=5, weights=weights, **options).transform(q).collect()
        assert len(got) == len(queries) and got[0].asDict()["x"] == 7
        assert {r.i: r.prediction for r in got} == pytest.approx(expected)


def test_neighbours_of_few_rows(spark):
    t = spark.createDataFrame([(Vectors.dense([float(i), 0.0]), float(i)) for i in (0, 1, 5)], ["features", "label"])
    q = spark.createDataFrame([(Vectors.dense([4.0, 0.0]),), (Vectors.dense([-9.0, 1.0]),)], ["features"])
    got = fit_knn(t, k=3).transform(q).collect()
    assert [r.prediction for r in got] == [2.0, 2.0]
    assert fit_knn(t, k=1).transform(q.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fit_knn(t, k=4)


def test_fits_do_not_depend_on_partitioning(data):
    for model in ("linear", "elasticnet", "basic_median_delta"):
        a = estimator(model, scaling="robust", **SETTINGS[model]).fit(data.repartition(1)).transform(data)
        b = estimator(model, scaling="robust", **SETTINGS[model]).fit(data.repartition(8)).transform(data)
        both = a.select("k", F.col("prediction").alias("a")).join(b.select("k", "prediction"), "k")
        assert both.where(F.abs(F.col("a") - F.col("prediction")) > 1e-8).count() == 0


def test_search_and_three_zones(spark, data):
    assert len(draw_settings(GRIDS["random_forest"], 40, 1)) == 40
    assert draw_settings(GRIDS["knn"], 40, 1) == draw_settings(GRIDS["knn"], 99, 2)
    best, tried = random_search(estimator("decision_tree"), data, ["k"], n_iter=5, cv=3, grid={"maxDepth": [1, 5]})
    assert [s for s, _ in sorted(tried, key=lambda t: t[1])][0] == {"maxDepth": 5}
    assert best.fitted.depth == 5
    zones = data.unionByName(data.withColumn("zone", F.lit("other")).withColumn("k", F.col("k") + 1000))
    got = train_and_score(zones, "m", estimator("linear", scaling="standard"), ["k"], 0.3, n_train_records=100)
    sizes = {(r.zone, r.split): r.n for r in got.collect()}
    assert sizes == {("m", "train"): 100, ("m", "test"): 90, ("other", "test"): 300}
    with pytest.raises(ValueError):
        CalibrationEstimator("unknown", "y", numeric=["x"])


def test_ensemble_of_fitted_models(data):
    models = [estimator("decision_tree", maxDepth=d).fit(data) for d in (1, 2, 3, 4)]
    votes = {}
    for m in models:
        for r in m.transform(data).collect():
            votes.setdefault(r.k, []).append(r.prediction)
    got = ensemble_of_models(models, data)
    assert got.columns == data.columns + ["q1", "median", "q3", "iqr"]
    for r in got.collect():
        q1, median, q3 = np.percentile(votes[r.k], [25, 50, 75])
        assert (r.q1, r.median, r.q3, r.iqr) == pytest.approx((q1, median, q3, q3 - q1))
