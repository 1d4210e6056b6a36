"""Queries that fit models and score them per zone."""

from __future__ import annotations

import functools
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.catalog.registry import LINE_KEY, pairs, query, rounded, table
from fieldcal.models.training import CalibrationEstimator, CalibrationModel, random_search, train_and_score
from fieldcal.operators.metrics import regression_metrics
from fieldcal.operators.ordering import exact_split, hash_key
from fieldcal.operators.prep import apply_scaling, augment, fit_scaling, linear_expression, unscale_linear
from fieldcal.session import scratch_path, stored

_NUMERIC = ["l_discount", "l_tax", "l_linenumber", "raw"]
_CATEGORICAL = ["l_linestatus", "l_returnflag"]


def _rows(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(*LINE_KEY, "truth", "raw", "zone", "split")
    return stored(rows, "training")


def _estimator(model, **options):
    return CalibrationEstimator(
        model, "truth", numeric=_NUMERIC, categorical=_CATEGORICAL, raw="raw", key=LINE_KEY, seed=14593, **options
    )


_LINE_SQL = """
WITH p AS (SELECT l_extendedprice / 2003 AS truth, l_quantity AS raw, l_returnflag AS zone,
                  CASE WHEN l_linenumber % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM lineitem),
f AS (SELECT regr_slope(truth, raw) AS a, regr_intercept(truth, raw) AS b FROM p WHERE split = 'train'),
s AS (SELECT zone, split, truth, a * raw + b AS prediction FROM p, f)
SELECT zone, split, count(*) AS n, round(1 - avg(pow(truth - prediction, 2)) / var_pop(truth), 6) AS r2,
  round(avg(abs(truth - prediction)), 6) AS mae, round(avg(pow(truth - prediction, 2)), 6) AS mse,
  round(sqrt(avg(pow(truth - prediction, 2))), 6) AS rmse FROM s GROUP BY zone, split"""


@query(_LINE_SQL)
def fit_linear_one_feature(spark, sf_dir):
    """Least squares on the raw value alone, which SQL can state in closed form."""
    rows = _rows(spark, sf_dir)
    line = CalibrationEstimator("linear", "truth", numeric=["raw"], scaling="robust").fit(rows.where("split = 'train'"))
    return rounded(regression_metrics(line.transform(rows), "truth", "prediction", ["zone", "split"]))


@query(
    """WITH p AS (SELECT l_extendedprice / 2003 AS truth, l_quantity AS raw FROM lineitem)
    SELECT round(regr_slope(truth, raw), 6) AS slope, round(regr_intercept(truth, raw), 6) AS intercept,
           round(avg(regr.a * raw + regr.b), 6) AS mean_prediction
    FROM p, (SELECT regr_slope(truth, raw) AS a, regr_intercept(truth, raw) AS b FROM p) regr"""
)
def linear_unscale(spark, sf_dir):
    """Coefficients of a fit on robust-scaled values, brought back to raw values."""
    rows = _rows(spark, sf_dir)
    fitted = CalibrationEstimator("linear", "truth", numeric=["raw"], scaling="robust").fit(rows)
    scaling = fit_scaling(rows, ["raw"], "robust")
    coefficients, intercept = unscale_linear({"raw": fitted.fitted.coefficients[0]}, fitted.fitted.intercept, scaling)
    scored = rows.withColumn("p", linear_expression(coefficients, intercept))
    return rounded(
        scored.agg(F.avg("p").alias("mean_prediction")).withColumns(
            {"slope": F.lit(coefficients["raw"]), "intercept": F.lit(intercept)}
        )
    )


_TRAIN_SQL = (
    "p AS (SELECT *, l_extendedprice / 2003 AS truth, l_quantity AS raw, l_returnflag AS zone, "
    "CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, "
    "CASE WHEN l_linenumber % 3 = 0 THEN 'test' ELSE 'train' END AS split, md5('14593|' || "
    + " || '|' || ".join(LINE_KEY)
    + ") AS key FROM lineitem), train AS (SELECT * FROM p WHERE split = 'train')"
)
_METRICS_SQL = """count(*) AS n, round(1 - avg(pow(truth - prediction, 2)) / var_pop(truth), 6) AS r2,
  round(avg(abs(truth - prediction)), 6) AS mae, round(avg(pow(truth - prediction, 2)), 6) AS mse,
  round(sqrt(avg(pow(truth - prediction, 2))), 6) AS rmse"""

# ---------------------------------------------------------------- fits whose optimum SQL can state: no feature moves with the residual


def _balance(scored, residual):
    """Per number and per category value: rows, and the sum of residual times feature as a share of its largest size."""
    r = residual.cast("double")
    numbers = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in _NUMERIC]
    levels = [F.struct(F.concat(F.lit(f"{c}="), F.col(c)).alias("feature"), F.lit(1.0).alias("x")) for c in _CATEGORICAL]
    long = scored.select(r.alias("r"), F.inline(F.array(*numbers, *levels)))
    share = F.sum(F.col("r") * F.col("x")) / F.sum(F.abs(F.col("r") * F.col("x")))
    return long.groupBy("feature").agg(F.count("*").alias("n"), (F.round(share, 3) + 0.0).alias("balance"))


def _balance_sql(source: str) -> str:
    numbers = ", ".join(f"('{c}')" for c in _NUMERIC)
    levels = " UNION ALL ".join(f"SELECT '{c}=' || {c} AS feature, count(*) AS n FROM {source} GROUP BY {c}" for c in _CATEGORICAL)
    return f"""SELECT feature, n, 0.0::DOUBLE AS balance FROM (
      SELECT feature, (SELECT count(*) FROM {source}) AS n FROM (VALUES {numbers}) v(feature) UNION ALL {levels})"""


def _fitted(spark, sf_dir, model, **options):
    train = _rows(spark, sf_dir).where("split = 'train'")
    return _estimator(model, **options).fit(train), train


@query(f"WITH {_TRAIN_SQL} {_balance_sql('train')}")
def fit_linear(spark, sf_dir):
    """Least squares on all features: the residual is balanced on each."""
    fitted, train = _fitted(spark, sf_dir, "linear", scaling="standard")
    return _balance(fitted.transform(train), F.col("truth") - F.col("prediction"))


@query(
    f"""WITH {_TRAIN_SQL} SELECT (i + 1)::INTEGER AS feature, 0.0::DOUBLE AS violation, (SELECT count(*) FROM train) AS n
    FROM range((SELECT count(DISTINCT l_linestatus) + count(DISTINCT l_returnflag) + {len(_NUMERIC)} FROM train)) r(i)"""
)
def fit_elasticnet(spark, sf_dir):
    """How far each feature is from the optimality condition of the chosen penalty: not at all."""
    share = 0.5
    fitted, train = _fitted(spark, sf_dir, "elasticnet", scaling="robust", l1_ratio=share, n_alphas=20)
    line = fitted.fitted
    ready = fitted.featurizer.transform(apply_scaling(train, fitted.meta["scaling"]))
    scored = line.transform(ready).withColumn("r", F.col("truth") - F.col("prediction"))
    pull = scored.select("r", F.posexplode(vector_to_array("features")).alias("at", "x"))
    w = F.array(*[F.lit(float(c)) for c in line.coefficients])[F.col("at")]
    l1, l2 = F.lit(line.penalty * share), F.lit(line.penalty * (1 - share))
    slope = pull.groupBy("at").agg(F.avg(F.col("r") * F.col("x")).alias("g"), F.count("*").alias("n"))
    off = F.when(w == 0, F.greatest(F.lit(0.0), F.abs("g") - l1)).otherwise(F.abs(F.col("g") - l2 * w - l1 * F.sign(w)))
    return slope.select((F.col("at") + 1).alias("feature"), F.round(off, 5).alias("violation"), "n")


@query(f"WITH {_TRAIN_SQL} {_balance_sql('train')}")
def fit_glm_gamma(spark, sf_dir):
    """Gamma regression with a log link: the relative residual is balanced."""
    fitted, train = _fitted(spark, sf_dir, "gamma", scaling="standard", regParam=0.0, maxIter=100, tol=1e-10)
    return _balance(fitted.transform(train), F.col("truth") / F.col("prediction") - 1)


@query(f"WITH {_TRAIN_SQL} {_balance_sql('train')}")
def fit_glm_poisson(spark, sf_dir):
    fitted, train = _fitted(spark, sf_dir, "poisson", scaling="standard", regParam=0.0, maxIter=100, tol=1e-10)
    return _balance(fitted.transform(train), F.col("truth") - F.col("prediction"))


@query(f"WITH {_TRAIN_SQL} {_balance_sql('train')}")
def fit_huber(spark, sf_dir):
    """Huber loss: the residual, cut at 1.35 of its scale, is balanced."""
    fitted, train = _fitted(spark, sf_dir, "sgd", scaling="standard", loss="huber", regParam=0.0, maxIter=500, tol=1e-12)
    r = (F.col("truth") - F.col("prediction")) / fitted.fitted.scale
    return _balance(fitted.transform(train), F.greatest(F.lit(-1.35), F.least(F.lit(1.35), r)))


@query(f"WITH {_TRAIN_SQL} {_balance_sql('train')}")
def fit_log_target_rescaled(spark, sf_dir):
    """Logarithm of the target: the residual of the fit, before re-scaling, is balanced in logarithms."""
    fitted, train = _fitted(spark, sf_dir, "linear", scaling="minmax", linear_scaling=True, log_scale_target=True)
    return _balance(fitted.raw_transform(train), F.log1p("truth") - F.col("prediction"))


@query(
    f"""WITH {_TRAIN_SQL}, t AS (SELECT quantile_cont(truth, 0.9) AS lim FROM train),
    u AS (SELECT * FROM train UNION ALL SELECT train.* FROM train, t, range(1, 3) c(copy) WHERE truth > lim)
    {_balance_sql('u')}"""
)
def fit_augmented(spark, sf_dir):
    """Rare targets copied with noise: the residual is balanced on the rows with their copies."""
    mode = "simple_0.90_2_0.04_0.04"
    fitted, train = _fitted(spark, sf_dir, "linear", scaling="robust", augmentation=mode)
    rows = augment(train, mode, "truth", _NUMERIC, hash_key(14593, *[F.col(c) for c in LINE_KEY]), 14593)
    return _balance(fitted.transform(rows), F.col("truth") - F.col("prediction"))


# ---------------------------------------------------------------- trees on two two-valued categories: cell means

_CELLS = ["half", "parity"]
_CELL_SQL = f"{_TRAIN_SQL}, g AS (SELECT half, parity, avg(truth) AS prediction FROM train GROUP BY half, parity)"
_CELL_METRICS_SQL = f"""WITH {_CELL_SQL}, s AS (SELECT zone, split, truth, prediction FROM p JOIN g USING (half, parity))
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""


def _cell_rows(spark, sf_dir):
    """Training rows with two two-valued text columns and a number that never changes."""
    return _rows(spark, sf_dir).withColumns(
        {
            "half": F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd"),
            "parity": F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd"), "level": F.lit(0.0),
        }
    )


def _cell_estimator(model, **setting):
    return CalibrationEstimator(model, "truth", numeric=["level"], categorical=_CELLS, raw="raw", key=LINE_KEY, seed=14593, **setting)


def _score_cells(spark, sf_dir, model, **setting):
    rows = _cell_rows(spark, sf_dir)
    fitted = _cell_estimator(model, **setting).fit(rows.where("split = 'train'"))
    return rounded(regression_metrics(fitted.transform(rows), "truth", "prediction", ["zone", "split"]))


@query(_CELL_METRICS_SQL)
def fit_tree(spark, sf_dir):
    return _score_cells(spark, sf_dir, "decision_tree", maxDepth=2)


#: Upper ends of the shares of 0, 1, 2… draws of a row.
_DRAWS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
_RESAMPLED_SQL = f"""{_TRAIN_SQL},
    u AS (SELECT train.*, t, ('0x' || substr(md5('14593|draw|' || (t // 4) || '|' || key), (1 + 8 * (t % 4))::INTEGER, 8))::BIGINT::DOUBLE / 4294967296 AS u
          FROM train, range(3) r(t)),
    d AS (SELECT *, {" + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in _DRAWS)} AS w FROM u),
    c AS (SELECT t, half, parity, sum(w * truth) / sum(w) AS v FROM d GROUP BY ALL),
    o AS (SELECT key, any_value(truth) AS y, avg(v) AS vote FROM d JOIN c USING (t, half, parity) WHERE w = 0 GROUP BY key),
    g AS (SELECT half, parity, avg(v) AS prediction FROM c GROUP BY half, parity),
    s AS (SELECT zone, split, truth, prediction FROM p JOIN g USING (half, parity))"""
_RESAMPLED_METRICS_SQL = f"""WITH {_RESAMPLED_SQL} SELECT zone, split, {_METRICS_SQL},
    (SELECT round(1 - avg(pow(y - vote, 2)) / var_pop(y), 6) FROM o) AS oob_r2 FROM s GROUP BY zone, split"""


def _score_resampled(spark, sf_dir, model, **setting):
    rows = _cell_rows(spark, sf_dir)
    fitted = _cell_estimator(model, numTrees=3, **setting).fit(rows.where("split = 'train'"))
    scores = regression_metrics(fitted.transform(rows), "truth", "prediction", ["zone", "split"])
    return rounded(scores.withColumn("oob_r2", F.lit(fitted.fitted.oob_r2)))


@query(_RESAMPLED_METRICS_SQL)
def fit_forest(spark, sf_dir):
    """Three resampled trees, features drawn for each node: weighted means of the cells, and the out-of-bag score."""
    return _score_resampled(spark, sf_dir, "random_forest", maxDepth=6, featureSubsetStrategy="sqrt", min_leaf=1)


@query(_RESAMPLED_METRICS_SQL)
def fit_bagging(spark, sf_dir):
    return _score_resampled(spark, sf_dir, "bagging")


def _gbt_sql(rounds: int, step: float) -> str:
    """Rounds of one cut each, by the flag that explains more of what is left; table f<rounds> holds the cells' predictions."""
    parts = ["f0 AS (SELECT half, parity, count(*) AS n, sum(truth) AS s, (SELECT avg(truth) FROM train) AS f FROM train GROUP BY ALL)"]
    for i in range(1, rounds + 1):
        was = f"f{i - 1}"
        for flag in ("half", "parity"):
            parts.append(f"{flag}{i} AS (SELECT {flag}, sum(s - n * f) / sum(n) AS m, pow(sum(s - n * f), 2) / sum(n) AS gain FROM {was} GROUP BY {flag})")
        first = f"(SELECT sum(gain) FROM half{i}) >= (SELECT sum(gain) FROM parity{i})"
        parts.append(
            f"f{i} AS (SELECT x.half, x.parity, n, s, f + {step}::DOUBLE * CASE WHEN {first} THEN h.m ELSE q.m END AS f "
            f"FROM {was} x JOIN half{i} h ON h.half = x.half JOIN parity{i} q ON q.parity = x.parity)"
        )
    return ", ".join(parts)


@query(
    f"""WITH {_TRAIN_SQL}, {_gbt_sql(3, 0.4)}, s AS (SELECT zone, split, truth, f AS prediction FROM p JOIN f3 USING (half, parity))
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_gbt(spark, sf_dir):
    """Three rounds of one cut each, with the step."""
    return _score_cells(spark, sf_dir, "gradient_boosting", maxIter=3, maxDepth=1, stepSize=0.4)


def _gbt_quantile_sql(rounds: int, step: float, alpha: float) -> str:
    """The same for a quantile: cuts explain the signs of the residuals, leaves hold the residuals' quantile."""
    parts = [f"f0 AS (SELECT half, parity, truth, (SELECT quantile_cont(truth, {alpha}) FROM train) AS f FROM train)"]
    for i in range(1, rounds + 1):
        was, sign = f"f{i - 1}", f"CASE WHEN truth > f THEN {alpha}::DOUBLE ELSE {alpha - 1}::DOUBLE END"
        for flag in ("half", "parity"):
            parts.append(f"{flag}{i} AS (SELECT {flag}, quantile_cont(truth - f, {alpha}) AS m, pow(sum({sign}), 2) / count(*) AS gain FROM {was} GROUP BY {flag})")
        first = f"(SELECT sum(gain) FROM half{i}) >= (SELECT sum(gain) FROM parity{i})"
        parts.append(
            f"f{i} AS (SELECT x.half, x.parity, truth, f + {step}::DOUBLE * CASE WHEN {first} THEN h.m ELSE q.m END AS f "
            f"FROM {was} x JOIN half{i} h ON h.half = x.half JOIN parity{i} q ON q.parity = x.parity)"
        )
    return ", ".join([*parts, f"g AS (SELECT half, parity, any_value(f) AS prediction FROM f{rounds} GROUP BY ALL)"])


@query(
    f"""WITH {_TRAIN_SQL}, {_gbt_quantile_sql(2, 0.5, 0.75)}, s AS (SELECT zone, split, truth, prediction FROM p JOIN g USING (half, parity))
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_gbt_quantile(spark, sf_dir):
    """Two rounds for the upper quartile."""
    return _score_cells(spark, sf_dir, "gradient_boosting", loss="quantile", alpha=0.75, maxIter=2, maxDepth=1, stepSize=0.5)


@query(
    f"""WITH {_TRAIN_SQL}, v AS (SELECT *, ('0x' || substr(md5('14593|validation|' || {" || '|' || ".join(LINE_KEY)}), 1, 8))::BIGINT::DOUBLE / 4294967296 < 0.25 AS held FROM train),
    g AS (SELECT half, parity, avg(truth) AS prediction FROM v WHERE NOT held GROUP BY ALL),
    s AS (SELECT zone, split, truth, prediction FROM p JOIN g USING (half, parity))
    SELECT zone, split, 4::INTEGER AS rounds, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_gbt_stops_early(spark, sf_dir):
    """With a step of 1 the first tree says all it can; three rounds without gain on the rows held back end the fit, long before
    the hundredth."""
    rows = _cell_rows(spark, sf_dir)
    estimator = _cell_estimator(
        "gradient_boosting", maxIter=100, maxDepth=2, stepSize=1.0, validation_fraction=0.25, n_iter_no_change=3
    )
    fitted = estimator.fit(rows.where("split = 'train'"))
    scores = regression_metrics(fitted.transform(rows), "truth", "prediction", ["zone", "split"])
    return rounded(scores.withColumn("rounds", F.lit(len(fitted.fitted.trees))))


_CUT_SQL = f"""{_TRAIN_SQL}, q AS (SELECT *, least(3, floor(raw / 13))::INTEGER AS x FROM train),
    sides AS (SELECT c, x > c AS above, count(*) AS n, sum(truth) AS s, median(truth) AS m FROM q, range(3) r(c) GROUP BY ALL),
    away AS (SELECT sides.c, sum(abs(truth - m)) AS e FROM q JOIN sides ON sides.above = (q.x > sides.c) GROUP BY 1),
    best AS (
      SELECT 'squared_error' AS criterion, arg_max(c, g) AS c FROM (SELECT c, sum(s * s / n) AS g FROM sides GROUP BY c)
      UNION ALL SELECT 'poisson', arg_max(c, g) FROM (SELECT c, sum(s * ln(s / n)) AS g FROM sides GROUP BY c)
      UNION ALL SELECT 'absolute_error', arg_min(c, e) FROM away),
    s AS (SELECT criterion, zone, split, truth, CASE criterion WHEN 'absolute_error' THEN m ELSE sides.s / n END AS prediction
          FROM p JOIN best ON true JOIN sides ON sides.c = best.c AND sides.above = (least(3, floor(raw / 13))::INTEGER > sides.c))"""


@query(f"WITH {_CUT_SQL} SELECT criterion, zone, split, {_METRICS_SQL} FROM s GROUP BY criterion, zone, split")
def fit_tree_criteria(spark, sf_dir):
    """The best cut of a four-valued feature by squared error, Poisson deviance and absolute error."""
    rows = _rows(spark, sf_dir).withColumn("x", F.least(F.lit(3), F.floor(F.col("raw") / 13)).cast("double"))
    train, criteria = rows.where("split = 'train'"), ["squared_error", "poisson", "absolute_error"]
    for name in criteria:
        model = CalibrationEstimator("decision_tree", "truth", numeric=["x"], raw="raw", key=LINE_KEY, seed=14593, criterion=name, maxDepth=1)
        rows = model.fit(train).transform(rows).withColumnRenamed("prediction", f"p_{name}")
    choices = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(f"p_{n}").alias("prediction")) for n in criteria])
    long = rows.select("zone", "split", "truth", F.inline(choices))
    return rounded(regression_metrics(long, "truth", "prediction", ["criterion", "zone", "split"]))


def _boost_sql(rounds: int) -> str:
    """Rounds of weighted cell means; weight, error and cost of each row as columns w, e, c of table b<round>."""
    steps, w = [], "1.0::DOUBLE"
    for i in range(1, rounds + 1):
        source = "train" if i == 1 else f"b{i - 1}, a{i - 1}"
        weight = w if i == 1 else f"w{i - 1} * pow(beta{i - 1}, 1 - c{i - 1})"
        steps.append(f"v{i} AS (SELECT *, {weight} AS w{i} FROM {source})")
        steps.append(f"m{i} AS (SELECT half, parity, sum(w{i} * truth) / sum(w{i}) AS p{i} FROM v{i} GROUP BY half, parity)")
        steps.append(f"e{i} AS (SELECT *, abs(truth - p{i}) AS d{i} FROM v{i} JOIN m{i} USING (half, parity))")
        steps.append(f"b{i} AS (SELECT *, d{i} / max(d{i}) OVER () AS c{i} FROM e{i})")
        steps.append(f"a{i} AS (SELECT x / (1 - x) AS beta{i} FROM (SELECT sum(w{i} * c{i}) / sum(w{i}) AS x FROM b{i}))")
    votes = " UNION ALL ".join(f"SELECT half, parity, p{i} AS p, ln(1 / beta{i}) AS w FROM m{i}, a{i}" for i in range(1, rounds + 1))
    return ", ".join([
        *steps, f"votes AS ({votes})",
        "running AS (SELECT *, sum(w) OVER (PARTITION BY half, parity ORDER BY p) AS seen, sum(w) OVER (PARTITION BY half, parity) AS whole FROM votes)",
        "chosen AS (SELECT half, parity, min(p) AS prediction FROM running WHERE seen >= whole / 2 GROUP BY half, parity)",
    ])


@query(
    f"""WITH {_TRAIN_SQL}, {_boost_sql(3)}, s AS (SELECT zone, split, truth, prediction FROM p JOIN chosen USING (half, parity))
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_adaboost_r2(spark, sf_dir):
    """Three rounds of re-weighted trees and their weighted median."""
    return _score_cells(spark, sf_dir, "adaboost", n_estimators=3, loss="linear", max_depth=2)


_KNN_SPLIT_SQL = """
k AS (SELECT *, row_number() OVER (ORDER BY md5('9|' || c_custkey)) AS r, count(*) OVER () AS n FROM customer),
t AS (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS x2, c_acctbal * 2 + c_nationkey AS y, c_mktsegment AS zone,
             CASE WHEN r <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k)"""


@query(
    f"""WITH {_KNN_SPLIT_SQL},
    d AS (SELECT a.c_custkey, a.zone, a.y, b.y AS near_y,
          sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d
          FROM t a, t b WHERE a.split = 'test' AND b.split = 'train'),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, near_y) <= 5),
    p AS (SELECT c_custkey, zone, y, CASE WHEN min(d) = 0 THEN avg(near_y) FILTER (d = 0)
          ELSE sum(near_y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END AS prediction FROM n GROUP BY ALL)
    SELECT zone, count(*) AS n, round(1 - avg(pow(y - prediction, 2)) / var_pop(y), 6) AS r2, round(avg(abs(y - prediction)), 6) AS mae,
           round(avg(pow(y - prediction, 2)), 6) AS mse, round(sqrt(avg(pow(y - prediction, 2))), 6) AS rmse FROM p GROUP BY zone"""
)
def fit_knn(spark, sf_dir):
    """Exact neighbours, so SQL can state the result too."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("x2"),
        (F.col("c_acctbal") * 2 + F.col("c_nationkey")).alias("y"), F.col("c_mktsegment").alias("zone"),
    )
    split = exact_split(c, ["c_custkey"], 0.3, 9)
    model = CalibrationEstimator("knn", "y", numeric=["c_acctbal", "x2"], k=5, weights="distance").fit(
        split.where("split = 'train'")
    )
    return rounded(regression_metrics(model.transform(split.where("split = 'test'")), "y", "prediction", ["zone"]))


@query(
    """WITH q AS (SELECT p_partkey, p_brand AS zone, p_retailprice * p_size / 10 AS a, p_size::DOUBLE AS b FROM part),
    t AS (SELECT l_extendedprice AS a, l_quantity AS b, l_extendedprice / 500 + l_tax * 100 AS y FROM lineitem),
    n AS (SELECT p_partkey, any_value(zone) AS zone, min({'d': sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b)), 'y': t.y}, 7) AS near
          FROM q, t GROUP BY p_partkey),
    e AS (SELECT p_partkey, zone, unnest(near) AS e FROM n),
    p AS (SELECT p_partkey, zone, avg(e.y) AS prediction, max(e.d) AS reach FROM e GROUP BY ALL)
    SELECT zone, count(*) AS n, round(avg(prediction), 6) AS prediction, round(min(prediction), 6) AS least, round(max(prediction), 6) AS most FROM p GROUP BY zone"""
)
def fit_knn_all_lines(spark, sf_dir):
    """Every line item is a training row; the parts ask for their seven nearest."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"), (F.col("l_extendedprice") / 500 + F.col("l_tax") * 100).alias("y")
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("zone"), (F.col("p_retailprice") * F.col("p_size") / 10).alias("a"), F.col("p_size").cast("double").alias("b")
    )
    scored = CalibrationEstimator("knn", "y", numeric=["a", "b"], k=7).fit(lines).transform(parts)
    return rounded(
        scored.groupBy("zone").agg(
            F.count("*").alias("n"), F.avg("prediction").alias("prediction"), F.min("prediction").alias("least"), F.max("prediction").alias("most")
        )
    )


@query(
    f"""WITH {_TRAIN_SQL}, f AS (SELECT *, ntile(3) OVER (ORDER BY key) AS fold FROM train),
    g AS (SELECT h.fold, half, parity, avg(truth) AS prediction FROM range(1, 4) h(fold) JOIN f ON f.fold <> h.fold GROUP BY ALL),
    e AS (SELECT fold, sqrt(avg(pow(truth - prediction, 2))) AS e FROM f JOIN g USING (fold, half, parity) GROUP BY fold)
    SELECT '[(''maxDepth'', ' || d.d || ')]' AS setting, round(avg(e), 6) AS rmse FROM e, (VALUES (2), (4), (6)) d(d) GROUP BY d.d"""
)
def search_cv(spark, sf_dir):
    """Error of every tried setting, from a seeded search on contiguous folds."""
    train = _cell_rows(spark, sf_dir).where("split = 'train'").drop("split")
    _, tried = random_search(_cell_estimator("decision_tree"), train, LINE_KEY, n_iter=3, cv=3, seed=14593, grid={"maxDepth": [2, 4, 6]})
    rows = [(str(sorted(setting.items())), rmse) for setting, rmse in tried]
    return rounded(spark.createDataFrame(rows, "setting string, rmse double"))


_KEYED_SQL = (
    "p AS (SELECT *, l_extendedprice / 2003 AS truth, l_quantity AS raw, l_returnflag AS zone, "
    "CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, md5('14593|' || "
    + " || '|' || ".join(LINE_KEY)
    + """) AS key FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY key) AS r, count(*) OVER (PARTITION BY zone) AS n FROM p),
parts AS (SELECT *, CASE WHEN zone <> 'A' OR r <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k)"""
)
_ZONE_METRICS_SQL = """SELECT zone, split, count(*) AS n, round(1 - avg(pow(truth - prediction, 2)) / var_pop(truth), 6) AS r2,
  round(avg(abs(truth - prediction)), 6) AS mae, round(avg(pow(truth - prediction, 2)), 6) AS mse,
  round(sqrt(avg(pow(truth - prediction, 2))), 6) AS rmse,
  round(1 - avg(pow(truth - prediction, 2)) / var_pop(truth + raw), 6) AS r2_sum_back,
  round(avg(abs(truth - prediction)), 6) AS mae_sum_back, round(avg(pow(truth - prediction, 2)), 6) AS mse_sum_back,
  round(sqrt(avg(pow(truth - prediction, 2))), 6) AS rmse_sum_back FROM s GROUP BY zone, split"""


@query(
    f"""WITH {_KEYED_SQL}, train AS (SELECT * FROM parts WHERE split = 'train'),
    g AS (SELECT half, parity, avg(truth) AS prediction FROM train GROUP BY half, parity),
    s AS (SELECT parts.*, prediction FROM parts JOIN g USING (half, parity))
    {_ZONE_METRICS_SQL}"""
)
def train_three_zones(spark, sf_dir):
    """Train on one zone, score all three, before and after adding the raw value back."""
    rows = _cell_rows(spark, sf_dir).drop("split")
    return rounded(train_and_score(rows, "A", _cell_estimator("decision_tree", maxDepth=2), LINE_KEY, test_size=0.3, grid={}))


_STEPS_SQL = f"""{_KEYED_SQL}, q AS (SELECT * REPLACE (truth + 3 * raw AS truth), least(3, floor(raw / 13))::INTEGER AS x FROM parts),
    f AS (SELECT *, ntile(3) OVER (ORDER BY key) AS fold FROM q WHERE split = 'train'),
    cuts AS (SELECT h.fold, c, x > c AS above, count(*) AS n, sum(truth) AS s FROM range(1, 4) h(fold) JOIN f ON f.fold <> h.fold, range(3) r(c) GROUP BY ALL),
    best AS (SELECT fold, arg_max(c, g) AS c FROM (SELECT fold, c, sum(s * s / n) AS g FROM cuts GROUP BY ALL) GROUP BY fold),
    one AS (SELECT fold, c, above, s / n AS v FROM cuts JOIN best USING (fold, c)),
    two AS (SELECT h.fold, x, avg(truth) AS v FROM range(1, 4) h(fold) JOIN f ON f.fold <> h.fold GROUP BY ALL),
    e AS (SELECT 1 AS d, f.fold, sqrt(avg(pow(truth - v, 2))) AS e FROM f JOIN one ON one.fold = f.fold AND one.above = (x > one.c) GROUP BY f.fold
          UNION ALL SELECT 3, f.fold, sqrt(avg(pow(truth - v, 2))) FROM f JOIN two ON two.fold = f.fold AND two.x = f.x GROUP BY f.fold),
    tried AS (SELECT d, avg(e) AS rmse FROM e GROUP BY d)"""


def _steps(spark, sf_dir):
    """All lines with a truth that follows a four-valued number, and a tree on that number alone."""
    rows = _rows(spark, sf_dir).drop("split").withColumns(
        {"x": F.least(F.lit(3), F.floor(F.col("raw") / 13)).cast("double"), "truth": F.col("truth") + 3 * F.col("raw")}
    )
    return rows, CalibrationEstimator("decision_tree", "truth", numeric=["x"], raw="raw", key=LINE_KEY, seed=14593)


@query(f"WITH {_STEPS_SQL} SELECT d::INTEGER AS depth, round(rmse, 6) AS rmse, rmse = (SELECT min(rmse) FROM tried) AS best FROM tried")
def search_winner(spark, sf_dir):
    """A search with one true winner: errors of both settings, and the setting of the refitted model."""
    rows, tree = _steps(spark, sf_dir)
    train = exact_split(rows.where("zone = 'A'"), LINE_KEY, 0.3, 14593).where("split = 'train'").drop("split")
    best, tried = random_search(tree, train, LINE_KEY, n_iter=2, cv=3, seed=14593, grid={"maxDepth": [1, 3]})
    table = [(s["maxDepth"], rmse, s["maxDepth"] == best.fitted.getOrDefault("maxDepth")) for s, rmse in tried]
    return rounded(spark.createDataFrame(table, "depth int, rmse double, best boolean"))


@query(
    f"""WITH {_STEPS_SQL}, g AS (SELECT x, avg(truth) AS deep FROM q WHERE split = 'train' GROUP BY x),
    all_cuts AS (SELECT c, x > c AS above, count(*) AS n, sum(truth) AS s FROM q, range(3) r(c) WHERE split = 'train' GROUP BY ALL),
    flat AS (SELECT above, c, s / n AS v FROM all_cuts WHERE c = (SELECT arg_max(c, g) FROM (SELECT c, sum(s * s / n) AS g FROM all_cuts GROUP BY c))),
    s AS (SELECT q.*, CASE WHEN (SELECT arg_min(d, rmse) FROM tried) = 3 THEN deep ELSE v END AS prediction
          FROM q JOIN g USING (x) JOIN flat ON flat.above = (q.x > flat.c))
    {_ZONE_METRICS_SQL}"""
)
def train_with_search(spark, sf_dir):
    """Train on one zone with a real search inside, and score all three with the winner."""
    rows, tree = _steps(spark, sf_dir)
    return rounded(train_and_score(rows, "A", tree, LINE_KEY, test_size=0.3, n_iter=2, cv=3, grid={"maxDepth": [1, 3]}))


@query(
    f"""WITH {_KEYED_SQL}, train AS (SELECT * FROM parts WHERE split = 'train'),
    f AS (SELECT regr_slope(truth, raw) AS a, regr_intercept(truth, raw) AS b FROM train),
    s AS (SELECT parts.*, a * raw + b AS prediction FROM parts, f)
    {_ZONE_METRICS_SQL}"""
)
def train_three_zones_one_feature(spark, sf_dir):
    """The same on the raw value alone, which SQL can state in closed form."""
    rows = _rows(spark, sf_dir).drop("split")
    line = CalibrationEstimator("linear", "truth", numeric=["raw"], key=LINE_KEY, scaling="robust", seed=14593)
    return rounded(train_and_score(rows, "A", line, LINE_KEY, test_size=0.3))


@query(
    f"""WITH {_KEYED_SQL}, train AS (SELECT * FROM parts WHERE split = 'train'),
    g AS (SELECT l_linestatus, l_linenumber, median(truth - raw) AS o FROM train GROUP BY ALL),
    f AS (SELECT median(truth - raw) AS o FROM train),
    s AS (SELECT parts.*, raw + coalesce(g.o, f.o) AS prediction FROM parts LEFT JOIN g USING (l_linestatus, l_linenumber), f)
    {_ZONE_METRICS_SQL}"""
)
def train_grouped_baseline(spark, sf_dir):
    rows = _rows(spark, sf_dir).drop("split")
    estimator = _estimator("basic_median_delta", groups=["l_linestatus", "l_linenumber"])
    return rounded(train_and_score(rows, "A", estimator, LINE_KEY, test_size=0.3))


@query(
    """SELECT l_returnflag AS zone, CASE WHEN l_linenumber % 3 = 0 THEN 'test' ELSE 'train' END AS split,
       0.0::DOUBLE AS largest_difference, count(*) AS n FROM lineitem GROUP BY 1, 2"""
)
def model_save_load(spark, sf_dir):
    """Predictions of a stored and re-read model: the largest difference is 0."""
    rows = _rows(spark, sf_dir)
    fitted = _estimator("decision_tree", scaling="standard", maxDepth=4).fit(rows.where("split = 'train'"))
    path = scratch_path(spark, "model")
    fitted.save(path, spark)
    again = CalibrationModel.load(path, spark)
    both = again.transform(fitted.transform(rows).withColumnRenamed("prediction", "first"))
    return rounded(
        both.groupBy("zone", "split").agg(
            F.max(F.abs(F.col("first") - F.col("prediction"))).alias("largest_difference"), F.count("*").alias("n")
        )
    )


#: Models that are stored in different ways; tests/test_models.py stores every name.
_STORED_MODELS = {
    "linear": {}, "gamma": {"maxIter": 5}, "random_forest": {"numTrees": 2, "maxDepth": 3}, "basic_median_delta": {},
}


@query(
    f"""SELECT model, count(*) AS n, 0.0::DOUBLE AS largest_difference
    FROM lineitem, (SELECT unnest({sorted(_STORED_MODELS)}) AS model) GROUP BY model"""
)
def model_pipeline_save_load(spark, sf_dir):
    """Models as stages of a pipeline that is stored and read back: all predictions are the same."""
    rows = _rows(spark, sf_dir)
    checked = []
    for model, setting in sorted(_STORED_MODELS.items()):
        stage = _estimator(model, scaling="standard", groups=["l_linestatus", "l_linenumber"], **setting)
        fitted, path = Pipeline(stages=[stage]).fit(rows.where("split = 'train'")), scratch_path(spark, "pipeline")
        fitted.write().save(path)
        both = PipelineModel.load(path).transform(fitted.transform(rows).withColumnRenamed("prediction", "first"))
        checked.append(
            both.select(F.lit(model).alias("model"), F.abs(F.col("first") - F.col("prediction")).alias("difference"))
        )
    together = functools.reduce(DataFrame.unionAll, checked)
    return together.groupBy("model").agg(F.count("difference").alias("n"), F.max("difference").alias("largest_difference"))


# ---------------------------------------------------------------- fits that SQL can state in closed form


def _line(model, **options):
    return CalibrationEstimator(model, "truth", numeric=["raw"], key=LINE_KEY, seed=14593, **options)


@query(
    f"""WITH {_TRAIN_SQL},
    f AS (SELECT regr_slope(ln(1 + truth), raw) AS a, regr_intercept(ln(1 + truth), raw) AS b FROM train),
    z AS (SELECT ln(1 + truth) AS z, a * raw + b AS p FROM train, f),
    l AS (SELECT covar_samp(z, p) / (var_pop(p) + 1e-12) AS slope, avg(z) - covar_samp(z, p) / (var_pop(p) + 1e-12) * avg(p) AS shift FROM z),
    s AS (SELECT zone, split, truth, exp(slope * (a * raw + b) + shift) - 1 AS prediction FROM p, f, l)
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_log_target_one_feature(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    fitted = _line("linear", scaling="minmax", linear_scaling=True, log_scale_target=True).fit(rows.where("split = 'train'"))
    return rounded(regression_metrics(fitted.transform(rows), "truth", "prediction", ["zone", "split"]))


def _noise(salt: str, sd: float) -> str:
    def uniform(part):
        return f"((('0x' || left(md5('14593|{salt}/{part}|' || k), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"

    return f"{sd} * sqrt(-2 * ln({uniform('r')})) * cos(2 * pi() * {uniform('a')})"


@query(
    f"""WITH {_TRAIN_SQL}, t AS (SELECT quantile_cont(truth, 0.9) AS lim FROM train),
    copies AS (SELECT train.*, key || '|' || c.copy AS k FROM train, t, range(1, 3) c(copy) WHERE truth > lim),
    u AS (SELECT raw, truth FROM train
          UNION ALL SELECT raw + {_noise("raw", 0.04)}, greatest(0, truth + {_noise("truth", 0.04)}) FROM copies),
    f AS (SELECT regr_slope(truth, raw) AS a, regr_intercept(truth, raw) AS b FROM u),
    s AS (SELECT zone, split, truth, a * raw + b AS prediction FROM p, f)
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_augmented_one_feature(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    fitted = _line("linear", scaling="standard", augmentation="simple_0.90_2_0.04_0.04").fit(rows.where("split = 'train'"))
    return rounded(regression_metrics(fitted.transform(rows), "truth", "prediction", ["zone", "split"]))


@query(
    f"""WITH {_TRAIN_SQL}, folded AS (SELECT raw AS x, truth AS y, ntile(5) OVER (ORDER BY key) AS fold FROM train),
    a AS (SELECT i.i, (SELECT abs(covar_pop(x, y)) / 0.5 FROM folded) * pow(0.001::DOUBLE, i.i / 19.0::DOUBLE) AS alpha FROM range(20) i(i)),
    m AS (SELECT h.fold, avg(t.x) AS mx, avg(t.y) AS my, covar_pop(t.x, t.y) AS c, var_pop(t.x) AS v
          FROM range(1, 6) h(fold) JOIN folded t ON t.fold <> h.fold GROUP BY h.fold),
    w AS (SELECT i, alpha, fold, mx, my, sign(c) * greatest(abs(c) - alpha * 0.5, 0) / (v + alpha * 0.5) AS w FROM m, a),
    e AS (SELECT i, alpha, fold, avg(pow(y - my - w * (x - mx), 2)) AS e FROM w JOIN folded USING (fold) GROUP BY ALL),
    best AS (SELECT arg_min(alpha, s) AS alpha FROM (SELECT alpha, sum(e) AS s FROM e GROUP BY alpha)),
    f AS (SELECT avg(x) AS mx, avg(y) AS my, sign(covar_pop(x, y)) * greatest(abs(covar_pop(x, y)) - any_value(alpha) * 0.5, 0)
                 / (var_pop(x) + any_value(alpha) * 0.5) AS w FROM folded, best),
    s AS (SELECT zone, split, truth, my + w * (raw - mx) AS prediction FROM p, f)
    SELECT zone, split, {_METRICS_SQL} FROM s GROUP BY zone, split"""
)
def fit_elasticnet_one_feature(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    fitted = _line("elasticnet", l1_ratio=0.5, n_alphas=20).fit(rows.where("split = 'train'"))
    return rounded(regression_metrics(fitted.transform(rows), "truth", "prediction", ["zone", "split"]))


# With one two-valued feature these models must all predict the mean of the group.
_GROUP_MODELS = {
    "linear": {}, "gamma": {"regParam": 0.0, "maxIter": 50, "tol": 1e-12}, "poisson": {"regParam": 0.0, "maxIter": 50, "tol": 1e-12},
    "sgd": {"loss": "squaredError", "regParam": 0.0}, "decision_tree": {"maxDepth": 1}, "gradient_boosting": {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0},
    "adaboost": {"n_estimators": 1, "max_depth": 1},
}
_GROUP_SQL = f"""{_TRAIN_SQL}, g AS (SELECT l_linestatus, avg(truth) AS prediction FROM train GROUP BY 1)"""


def _flagged(spark, sf_dir):
    return _rows(spark, sf_dir).withColumn("flag", (F.col("l_linestatus") == "F").cast("double"))


@query(
    f"""WITH {_GROUP_SQL}, s AS (SELECT zone, split, truth, prediction FROM p JOIN g USING (l_linestatus))
    SELECT m.model, zone, split, {_METRICS_SQL} FROM s, (VALUES {", ".join(f"('{m}')" for m in _GROUP_MODELS)}) m(model)
    GROUP BY m.model, zone, split"""
)
def fit_group_means(spark, sf_dir):
    """Seven models on one two-valued feature, scored in one aggregation."""
    rows = _flagged(spark, sf_dir)
    train, scored = rows.where("split = 'train'"), rows
    for model, setting in _GROUP_MODELS.items():
        fitted = CalibrationEstimator(model, "truth", numeric=["flag"], seed=14593, **setting).fit(train)
        scored = fitted.transform(scored).withColumnRenamed("prediction", f"p_{model}")
    choices = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("prediction")) for m in _GROUP_MODELS])
    long = scored.select("zone", "split", "truth", F.inline(choices))
    return rounded(regression_metrics(long, "truth", "prediction", ["model", "zone", "split"]))


@query(
    f"""WITH {_TRAIN_SQL}, f AS (SELECT *, ntile(3) OVER (ORDER BY key) AS fold FROM train),
    g AS (SELECT h.fold, l_linestatus, avg(truth) AS prediction FROM range(1, 4) h(fold) JOIN f ON f.fold <> h.fold GROUP BY ALL),
    e AS (SELECT fold, sqrt(avg(pow(truth - prediction, 2))) AS e FROM f JOIN g USING (fold, l_linestatus) GROUP BY fold)
    SELECT '[(''maxDepth'', ' || d.d || ')]' AS setting, round(avg(e), 6) AS rmse FROM e, (VALUES (1), (2)) d(d) GROUP BY d.d"""
)
def search_cv_group_means(spark, sf_dir):
    """A search whose fold errors SQL can state: every tree must predict the group mean of its folds."""
    train = _flagged(spark, sf_dir).where("split = 'train'").drop("split")
    estimator = CalibrationEstimator("decision_tree", "truth", numeric=["flag"], key=LINE_KEY, seed=14593)
    _, tried = random_search(estimator, train, LINE_KEY, n_iter=4, cv=3, seed=14593, grid={"maxDepth": [1, 2]})
    rows = [(str(sorted(setting.items())), rmse) for setting, rmse in tried]
    return rounded(spark.createDataFrame(rows, "setting string, rmse double"))
