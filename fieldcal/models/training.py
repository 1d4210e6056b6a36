"""Fit, tune and apply calibration models: one estimator for every model name."""

from __future__ import annotations

import importlib
import itertools
import json
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    LinearRegression,
)
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.functions.measure import clip
from fieldcal.models import baseline
from fieldcal.models.adaboost import BoostedMedian, fit_adaboost_r2
from fieldcal.models.elasticnet import FoldMoments, LinearFit
from fieldcal.models.glm import LogLinear, fit_glms
from fieldcal.models.knn import Neighbours, fit_knn
from fieldcal.models.persistence import StageReader, StageWriter
from fieldcal.models.trees import CRITERIA, LOSSES, TreeEnsemble, fit_boosting, fit_forest
from fieldcal.operators.metrics import linear_scaling, regression_metrics
from fieldcal.operators.ordering import contiguous_folds, hash_key, head_condition, split_label
from fieldcal.operators.prep import apply_scaling, augment, feature_pipeline, fit_scaling
from fieldcal.session import scratch_scope, stored

#: Models that always see all training rows, unscaled, with the plain target.
_ON_RAW_VALUES = ("cocal_only", "basic_median_delta")
#: Trees of the bagged model grow until their leaves are pure, or to the largest depth there is.
_FULL_DEPTH = 30
#: Models whose fit reads the ready rows many times; the others read them once or write a table of their own.
_MANY_READS = ("gamma", "poisson", "sgd", "decision_tree", "elasticnet")

BASELINES = ["cocal_only", "basic_median", "basic_median_plain_delta", "basic_median_delta"]

# Search grids, with the keys that have a Spark ML counterpart.
GRIDS: dict[str, dict[str, list]] = {
    "cocal_only": {},
    "basic_median": {},
    "basic_median_plain_delta": {},
    "basic_median_delta": {},
    "linear": {},
    "gamma": {"regParam": [1e-4, 1e-3, 1e-2, 1e-1, 1.0], "maxIter": [200, 400, 600, 100]},
    "poisson": {"regParam": [1e-4, 1e-3, 1e-2, 1e-1, 1.0], "maxIter": [200, 400, 600, 100]},
    "sgd": {
        "loss": ["squaredError", "huber"],
        "regParam": [1e-4, 1e-3, 1e-2, 1e-1],
        "elasticNetParam": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    },
    "elasticnet": {
        "l1_ratio": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
        "n_alphas": [5, 10, 20, 30, 50, 100, 200, 500, 1000, 2000],
    },
    "random_forest": {
        "numTrees": [10, 20, 50, 100, 150, 200],
        "maxDepth": [3, 6, 9, 12, 15],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
        "min_split": [2, 4, 6, 8],
        "min_leaf": [0.001, 0.01, 0.1, 1, 2, 4],
        "criterion": list(CRITERIA),
        "oob_score": [True, False],
    },
    "gradient_boosting": {
        "loss": list(LOSSES),
        "stepSize": [1e-4, 1e-3, 1e-2, 1e-1],
        "maxIter": [10, 20, 50, 100, 150, 200],
        "featureSubsetStrategy": ["sqrt", "log2"],
        "maxDepth": [3, 6, 9, 12, 15],
        "min_split": [2, 4, 6, 8],
        "min_leaf": [0.001, 0.01, 0.1, 1, 2, 4],
        "validation_fraction": [0.1, 0.2, 0.3],
        "n_iter_no_change": [10, 20, 30],
    },
    "bagging": {"numTrees": [10, 20, 50, 100, 150, 200], "oob_score": [True, False]},
    "adaboost": {
        "n_estimators": [10, 20, 50, 100, 150, 200],
        "learning_rate": [1e-4, 1e-3, 1e-2, 1e-1, 1.0],
        "loss": ["linear", "square", "exponential"],
    },
    "knn": {"k": [3, 5, 7], "weights": ["uniform", "distance"]},
    "decision_tree": {
        "criterion": list(CRITERIA),
        "splitter": ["best", "random"],
        "maxDepth": [3, 6, 9, 12, 15],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
    },
}


#: User models: fit(rows with ``features`` and ``label``, setting, seed) gives an object with ``transform(df)``, which adds ``prediction``.
_REGISTERED: dict[str, Callable[[DataFrame, Mapping[str, Any], int], Any]] = {}


def register_model(name: str, fit: Callable[[DataFrame, Mapping[str, Any], int], Any], grid: Mapping[str, Sequence] | None = None) -> None:
    """Make a model known by name, with the grid that a search draws from.

    What ``fit`` returns is stored with its own ``write()``, if it has one, as ML models do; it is read back with the ``load`` of its class.
    """
    if name in GRIDS and name not in _REGISTERED:
        raise ValueError(f"{name} is a model of the library")
    GRIDS[name], _REGISTERED[name] = dict(grid or {}), fit


@dataclass
class Prepared:
    """Training rows made ready once: augmented, scaled and encoded; fits of any setting start from them."""

    rows: DataFrame
    scaled: DataFrame
    scaling: dict[str, tuple[float, float]]
    featurizer: PipelineModel | None
    ready: DataFrame | None  # key columns, features, label


def make_regressor(name: str, params: Mapping[str, Any], seed: int) -> Estimator:
    """The Spark ML estimator of a model name, on columns ``features`` and ``label``."""
    if name == "linear":
        return LinearRegression(regParam=0.0, solver="normal", **params)
    if name == "sgd":
        if params.get("loss") == "huber":  # huber takes the squared penalty only
            params = {**params, "elasticNetParam": 0.0}
        return LinearRegression(standardization=False, **params)
    if name == "decision_tree":
        return DecisionTreeRegressor(seed=seed, **params)
    raise ValueError(f"unknown model {name}")


class CalibrationEstimator(Estimator, MLWritable, MLReadable):
    """Augment, scale, encode and fit one calibration model.

    ``raw`` is the sensor column the baselines build on; ``groups`` are the category columns of the
    grouped baseline; ``key`` identifies a row for hash-seeded noise. The param ``setting`` holds the
    hyper-parameters, so that ``copy`` makes one estimator per setting of a grid.
    """

    setting = Param(Params._dummy(), "setting", "hyper-parameters of the model")

    def __init__(
        self, model: str, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), raw: str | None = None,
        groups: Sequence[str] = (), key: Sequence[str] = (), scaling: str = "none", augmentation: str = "none",
        linear_scaling: bool = False, log_scale_target: bool = False, seed: int = 0, **setting: Any,
    ):
        super().__init__()
        if model not in GRIDS:
            raise ValueError(f"unknown model {model}; choose one of {sorted(GRIDS)}")
        if model in _ON_RAW_VALUES:
            scaling, augmentation, log_scale_target = "none", "none", False
        self.model, self.target, self.raw = model, target, raw or list(numeric)[-1]
        self.numeric, self.categorical, self.groups = list(numeric), list(categorical), list(groups)
        self.key, self.scaling, self.augmentation = list(key), scaling, augmentation
        self.linear_scaling, self.log_scale_target, self.seed = linear_scaling, log_scale_target, seed
        self._setDefault(setting=setting)

    def write(self) -> StageWriter:
        names = ("model", "target", "numeric", "categorical", "raw", "groups", "key", "scaling", "augmentation", "linear_scaling", "log_scale_target", "seed")
        return StageWriter(self, {name: getattr(self, name) for name in names})

    @classmethod
    def read(cls) -> StageReader:
        return StageReader(lambda options, path, spark: cls(**options))

    def _fit(self, dataset: DataFrame) -> CalibrationModel:
        with scratch_scope(dataset.sparkSession):
            return self.fit_prepared(self.prepare(dataset, self.model in _MANY_READS), [dict(self.getOrDefault(self.setting))])[0]

    def _label(self) -> Column:
        return F.log1p(self.target) if self.log_scale_target else F.col(self.target).cast("double")

    def prepare(self, dataset: DataFrame, write: bool = True) -> Prepared:
        """Augment, scale and encode; with ``write`` the result is written, for fits that read it many times."""
        key = hash_key(self.seed, *[F.col(c) for c in self.key]) if self.key else F.lit("")
        if self.augmentation != "none" and not self.key:
            raise ValueError("augmentation needs the key columns of a row")
        rows = augment(dataset, self.augmentation, self.target, self.numeric, key, self.seed)
        scaling = fit_scaling(rows, self.numeric, self.scaling)
        scaled = apply_scaling(rows, scaling)
        if self.model in BASELINES:
            return Prepared(rows, scaled, scaling, None, None)
        featurizer = feature_pipeline(self.categorical, self.numeric).fit(scaled)
        ready = featurizer.transform(scaled).select(*[F.col(c) for c in self.key], F.col("features"), self._label().alias("label"))
        return Prepared(rows, scaled, scaling, featurizer, stored(ready, "ready") if write else ready)

    def fit_prepared(self, prepared: Prepared, settings: Sequence[Mapping[str, Any]], parallelism: int = 1) -> list[CalibrationModel]:
        """One model for each setting. Least squares families share their passes over the rows among all settings."""
        if self.model in BASELINES:
            made = self._fit_baseline(prepared.scaled.withColumn("_label", self._label()), "_label")
            made.meta |= {"log_scale_target": self.log_scale_target, "scaling": {c: v for c, v in prepared.scaling.items() if v != (0.0, 1.0)}}
            return [self._post(made, prepared.rows)] * len(settings)
        ready = prepared.ready
        if self.model == "elasticnet":
            if self.key:
                folded = contiguous_folds(ready, self.key, 5, self.seed)
            else:
                folded = ready.withColumn("fold", F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(5)))
            moments = FoldMoments(folded)
            fitted = [moments.fit(**s) for s in settings]
        elif self.model in ("gamma", "poisson"):
            fitted = fit_glms(ready, self.model, settings)
        else:
            with ThreadPool(max(1, min(parallelism, len(settings)))) as pool:
                fitted = pool.map(lambda s: self._fit_model(ready, dict(s)), settings)
        meta = {
            "model": self.model, "numeric": self.numeric, "scaling": prepared.scaling, "log_scale_target": self.log_scale_target,
            "slope": 1.0, "intercept": 0.0,
        }
        return [self._post(CalibrationModel(dict(meta), prepared.featurizer, f), prepared.rows) for f in fitted]

    def _fit_model(self, ready: DataFrame, setting: dict[str, Any]) -> Any:
        if self.model in _REGISTERED:
            return _REGISTERED[self.model](ready, setting, self.seed)
        if self.model == "adaboost":
            return fit_adaboost_r2(ready, seed=self.seed, **setting)
        if self.model == "knn":
            return fit_knn(ready, **setting)
        own = [F.col(c) for c in self.key] or [F.xxhash64(vector_to_array("features"), "label")]
        row = hash_key(self.seed, *own)
        if self.model == "random_forest":
            return fit_forest(ready, row, self.seed, **{"numTrees": 20, "featureSubsetStrategy": "sqrt", **setting})
        if self.model == "bagging":
            return fit_forest(ready, row, self.seed, **{"maxDepth": _FULL_DEPTH, **setting})
        if self.model == "decision_tree" and set(setting) - {"maxDepth"}:
            return fit_forest(ready, row, self.seed, **{"numTrees": 1, "bootstrap": False, **setting})
        if self.model == "gradient_boosting":
            setting, held = dict(setting), None
            if "validation_fraction" in setting:  # a hashed share of the rows
                drawn = hash_key(self.seed, F.lit("validation"), *own)
                held = F.conv(F.left(drawn, F.lit(8)), 16, 10).cast("double") / float(2**32) < setting.pop("validation_fraction")
                setting.setdefault("n_iter_no_change", 10)
            return fit_boosting(ready, row, self.seed, validate=held, **setting)
        return make_regressor(self.model, setting, self.seed).fit(ready)

    def _fit_baseline(self, train: DataFrame, target: str) -> CalibrationModel:
        meta: dict[str, Any] = {
            "model": self.model, "raw": self.raw, "groups": self.groups, "offset": 0.0,
            "log_scale_target": False, "slope": 1.0, "intercept": 0.0,
        }
        offsets = None
        if self.model == "basic_median":
            meta["offset"] = baseline.median_of_target(train, target)
        elif self.model == "basic_median_plain_delta":
            meta["offset"] = baseline.median_of_delta(train, target, self.raw)
        elif self.model == "basic_median_delta":
            offsets, meta["offset"] = baseline.offsets_with_total(train, target, self.raw, self.groups)
        return CalibrationModel(meta, None, offsets)

    def _post(self, made: CalibrationModel, rows: DataFrame) -> CalibrationModel:
        if self.linear_scaling:
            scored = made.raw_transform(rows)
            truth = F.log1p(self.target) if self.log_scale_target else F.col(self.target)
            line = linear_scaling(scored.withColumn("_y", truth), "_y", "prediction").first()
            made.meta["slope"] = max(-1e15, min(1e15, line["slope"]))
            made.meta["intercept"] = max(-1e15, min(1e15, line["intercept"]))
        return made


class CalibrationModel(Model, MLWritable, MLReadable):
    """A fitted model; ``transform`` adds the column ``prediction``."""

    def __init__(self, meta: dict[str, Any], featurizer: PipelineModel | None, fitted: Any):
        super().__init__()
        self.meta, self.featurizer, self.fitted = meta, featurizer, fitted

    def raw_transform(self, df: DataFrame) -> DataFrame:
        """Prediction before target re-scaling."""
        kept = df.columns
        meta = self.meta
        if meta["model"] in BASELINES:
            if meta["model"] == "basic_median_delta":
                return baseline.grouped_prediction(df, meta["raw"], self.fitted, meta["groups"], meta["offset"])
            center, scale = meta.get("scaling", {}).get(meta["raw"], (0.0, 1.0))
            shifted = (F.col(meta["raw"]) - F.lit(float(center))) / F.lit(float(scale)) + F.lit(float(meta["offset"]))
            return df.withColumn("prediction", shifted)
        predicted = self.fitted.transform(self.ready(df))
        return predicted.select(
            *[F.col(f"_raw_{c}").alias(c) if c in meta["numeric"] else F.col(c) for c in kept], "prediction"
        )

    def ready(self, df: DataFrame) -> DataFrame:
        """Rows with ``features``; the original numbers are carried under other names, ``_raw_…``."""
        carried = df.withColumns({f"_raw_{c}": F.col(c) for c in self.meta["numeric"]})
        return self.featurizer.transform(apply_scaling(carried, self.meta["scaling"]))

    def post(self, prediction: Column) -> Column:
        """Target re-scaling of a raw prediction."""
        m = self.meta
        if m["slope"] == 1.0 and m["intercept"] == 0.0 and not m["log_scale_target"]:
            return prediction
        p = clip(F.lit(m["slope"]) * prediction) + F.lit(m["intercept"])
        return F.expm1(p) if m["log_scale_target"] else p

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.raw_transform(dataset).withColumn("prediction", self.post(F.col("prediction")))

    def write(self) -> StageWriter:
        return StageWriter(self, parts=self._write_parts)

    @classmethod
    def read(cls) -> StageReader:
        return StageReader(lambda options, path, spark: cls._read_parts(path, spark))

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Store the model; one that lies there is replaced."""
        self.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> CalibrationModel:
        return cls.read().load(path)

    # The featurizer and an ML model keep their own format, the rest is one JSON line.
    def _write_parts(self, path: str, spark: SparkSession) -> None:
        fitted, extra = self.fitted, {}
        if isinstance(fitted, LinearFit):
            extra = {"kind": "linear_fit", "linear_fit": vars(fitted)}
        elif isinstance(fitted, LogLinear):
            extra = {"kind": "log_linear", "linear_fit": vars(fitted.line)}
        elif isinstance(fitted, BoostedMedian):
            extra = {"kind": "boosted", "weights": fitted.weights}
            for i, tree in enumerate(fitted.trees):
                tree.write().overwrite().save(f"{path}/tree_{i}")
        elif isinstance(fitted, DataFrame):
            extra = {"kind": "table"}
            fitted.write.mode("overwrite").parquet(f"{path}/table")
        elif isinstance(fitted, TreeEnsemble):
            extra = {"kind": "trees", "trees": fitted.to_json()}
        elif fitted is None:
            extra = {"kind": "none"}
        elif hasattr(fitted, "write"):
            extra = {"kind": "ml", "class": [type(fitted).__module__, type(fitted).__qualname__]}
            fitted.write().overwrite().save(f"{path}/fitted")
        else:
            extra = {"kind": "neighbours", **{k: v for k, v in vars(fitted).items() if k not in ("rows", "cells")}}
            fitted.rows.write.mode("overwrite").parquet(f"{path}/table")
            fitted.cells.write.mode("overwrite").parquet(f"{path}/cells")
        if self.featurizer is not None:
            self.featurizer.write().overwrite().save(f"{path}/featurizer")
        line = json.dumps({"meta": self.meta, **extra, "featurized": self.featurizer is not None})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def _read_parts(cls, path: str, spark: SparkSession) -> CalibrationModel:
        record = json.loads(spark.read.text(f"{path}/meta").first()[0])
        meta, kind = record["meta"], record["kind"]
        if "scaling" in meta:
            meta["scaling"] = {c: tuple(v) for c, v in meta["scaling"].items()}
        featurizer = PipelineModel.load(f"{path}/featurizer") if record["featurized"] else None
        fitted: Any = None
        if kind == "ml":
            module, name = record["class"]
            fitted = getattr(importlib.import_module(module), name).load(f"{path}/fitted")
        elif kind == "linear_fit":
            fitted = LinearFit(**record["linear_fit"])
        elif kind == "log_linear":
            fitted = LogLinear(LinearFit(**record["linear_fit"]))
        elif kind == "boosted":
            trees = [DecisionTreeRegressionModel.load(f"{path}/tree_{i}") for i in range(len(record["weights"]))]
            fitted = BoostedMedian(trees, record["weights"])
        elif kind == "trees":
            fitted = TreeEnsemble.from_json(record["trees"])
        elif kind == "table":
            fitted = spark.read.parquet(f"{path}/table")
        elif kind == "neighbours":
            options = {k: record[k] for k in ("k", "weights", "block_rows")}
            fitted = Neighbours(spark.read.parquet(f"{path}/table"), spark.read.parquet(f"{path}/cells"), **options)
        return cls(meta, featurizer, fitted)


def draw_settings(grid: Mapping[str, Sequence], n_iter: int, seed: int) -> list[dict[str, Any]]:
    """``n_iter`` different settings of a grid, or all of them when there are fewer."""
    names = sorted(grid)
    every = [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]
    return every if len(every) <= n_iter else random.Random(seed).sample(every, n_iter)


def random_search(
    estimator: CalibrationEstimator, train: DataFrame, key: Sequence[str], n_iter: int = 40, cv: int = 4,
    seed: int = 0, parallelism: int = 4, grid: Mapping[str, Sequence] | None = None,
) -> tuple[CalibrationModel, list[tuple[dict[str, Any], float]]]:
    """Randomised search on contiguous folds with RMSE, refitted on all rows.

    Returns the refitted best model and every setting tried with its mean RMSE. A fold is prepared once, for all settings,
    and written; ``parallelism`` fits run at the same time. Of equal errors the setting drawn first wins.
    """
    settings = draw_settings(GRIDS[estimator.model] if grid is None else grid, n_iter, seed)
    errors = [[] for _ in settings]
    with scratch_scope(train.sparkSession):
        folded = stored(contiguous_folds(train, key, cv, seed), "folded")
        for fold in range(cv):
            with scratch_scope(train.sparkSession):
                prepared = estimator.prepare(folded.where(F.col("fold") != fold))
                models = estimator.fit_prepared(prepared, settings, parallelism)
                for i, rmse in enumerate(_rmse_of(models, folded.where(F.col("fold") == fold), estimator.target, parallelism)):
                    errors[i].append(rmse)
    tried = [(s, sum(e) / cv) for s, e in zip(settings, errors)]
    best = min(tried, key=lambda t: t[1])[0]
    return estimator.copy({estimator.setting: best}).fit(train), tried


def _rmse_of(models: Sequence[CalibrationModel], test: DataFrame, target: str, parallelism: int) -> list[float]:
    """Error of each model on the same rows; models that are formulas share one pass."""
    if all(isinstance(m.fitted, (LinearFit, LogLinear)) for m in models):
        ready = models[0].ready(test)
        x, truth = vector_to_array(F.col("features")), F.col(target)
        squares = [F.avg(F.pow(truth - m.post(m.fitted.column(x)), 2)).alias(f"e{i}") for i, m in enumerate(models)]
        return [float(e) ** 0.5 for e in ready.agg(*squares).first()]
    with ThreadPool(max(1, min(parallelism, len(models)))) as pool:
        return pool.map(lambda m: regression_metrics(m.transform(test), target, "prediction").first()["rmse"], models)


def train_and_score(
    zones: DataFrame, main_zone: str, estimator: CalibrationEstimator, key: Sequence[str], test_size: float = 0.3,
    n_iter: int = 40, cv: int = 4, n_train_records: int = 0, zone: str = "zone",
    grid: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Scores of :func:`train_zones`."""
    return train_zones(zones, main_zone, estimator, key, test_size, n_iter, cv, n_train_records, zone, grid)[2]


def train_zones(
    zones: DataFrame, main_zone: str, estimator: CalibrationEstimator, key: Sequence[str], test_size: float = 0.3,
    n_iter: int = 40, cv: int = 4, n_train_records: int = 0, zone: str = "zone",
    grid: Mapping[str, Sequence] | None = None,
) -> tuple[CalibrationModel, list[tuple[dict[str, Any], float]], DataFrame]:
    """Train on a seeded share of the main zone and score every zone: the model, the settings tried, the scores.

    The main zone is scored on its train and test rows, any other zone on all its rows. One
    ``transform`` and one aggregation give r2, mae, mse and rmse, also after adding the raw value back.
    """
    seed = estimator.seed
    main = F.col(zone) == main_zone
    label = split_label(zones.where(main), key, test_size, seed)
    labelled = zones.withColumn("split", F.when(main, label).otherwise("test"))
    in_train = F.col("split") == "train"  # only main-zone rows are ever labelled so
    if estimator.model in _ON_RAW_VALUES:
        n_train_records = 0
    kept = head_condition(labelled.where(in_train), key, n_train_records, seed)
    train = labelled.where(in_train & kept)
    if len(GRIDS[estimator.model] if grid is None else grid) > 0:
        model, tried = random_search(estimator, train.drop("split"), key, n_iter, cv, seed, grid=grid)
    else:
        model, tried = estimator.fit(train.drop("split")), []
    scored = model.transform(labelled.where(~in_train | kept))
    return model, tried, regression_metrics(scored, estimator.target, "prediction", [zone, "split"], raw=estimator.raw)
