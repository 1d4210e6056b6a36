"""Estimator and models inside ML pipelines and validators, stored and read back."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fieldcal.models.training import CalibrationEstimator, CalibrationModel
from tests.test_models import data, estimator  # noqa: F401


def _same(first, again, rows):
    both = first.transform(rows).select("k", F.col("prediction").alias("a")).join(again.transform(rows).select("k", "prediction"), "k")
    assert both.count() == 300 and both.where("a is distinct from prediction").count() == 0


def test_estimator_keeps_its_options_and_setting(data, tmp_path):  # noqa: F811
    made = estimator("decision_tree", scaling="robust", log_scale_target=True, linear_scaling=True, maxDepth=3)
    made.set(made.setting, {"maxDepth": 2})
    made.write().save(str(tmp_path / "e"))
    again = CalibrationEstimator.load(str(tmp_path / "e"))
    assert again.uid == made.uid and again.getOrDefault(again.setting) == {"maxDepth": 2}
    again.clear(again.setting)
    assert again.getOrDefault(again.setting) == {"maxDepth": 3}
    plain = {k: v for k, v in vars(made).items() if not k.startswith("_")}
    assert plain.keys() == {k for k in vars(again) if not k.startswith("_")}
    assert all(getattr(again, k) == v for k, v in plain.items() if k not in ("uid", "setting"))
    _same(made.fit(data), CalibrationEstimator.load(str(tmp_path / "e")).fit(data), data)


@pytest.mark.parametrize("model", ["linear", "basic_median_delta", "random_forest"])
def test_a_pipeline_is_stored_whole(data, tmp_path, model):  # noqa: F811
    doubled = SQLTransformer(statement="SELECT *, 2 * x AS twice FROM __THIS__")
    pipeline = Pipeline(stages=[doubled, estimator(model)])
    pipeline.write().save(str(tmp_path / "p"))
    fitted = Pipeline.load(str(tmp_path / "p")).fit(data)
    fitted.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [s.uid for s in again.stages] == [s.uid for s in fitted.stages] and "twice" in again.transform(data).columns
    _same(fitted, again, data)


def test_a_validator_chooses_a_setting_and_is_stored(data, tmp_path):  # noqa: F811
    made = estimator("decision_tree")
    grid = ParamGridBuilder().addGrid(made.setting, [{"maxDepth": 1}, {"maxDepth": 5}]).build()
    search = CrossValidator(estimator=made, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=2, seed=1)
    fitted = search.fit(data)
    assert fitted.avgMetrics[1] < fitted.avgMetrics[0]
    fitted.write().save(str(tmp_path / "v"))
    again = CrossValidatorModel.load(str(tmp_path / "v"))
    assert [list(m.values()) for m in again.getEstimatorParamMaps()] == [[{"maxDepth": 1}], [{"maxDepth": 5}]]
    _same(fitted, again, data)


def test_a_stored_model_is_not_overwritten_unless_asked(data, tmp_path):  # noqa: F811
    path = str(tmp_path / "m")
    first, second = estimator("basic_median").fit(data), estimator("linear").fit(data)
    first.write().save(path)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        second.write().save(path)
    second.save(path)
    _same(second, CalibrationModel.load(path), data)
