"""Regression metrics, each a single aggregation pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["r2", "mae", "mse", "rmse"]
_REGISTERED: dict[str, Callable[[Column, Column], Column]] = {}


def register_metric(name: str, expression: Callable[[Column, Column], Column]) -> None:
    """Make an aggregate of truth and prediction known by name; all scores then hold it too, in the same pass."""
    if name in METRICS and name not in _REGISTERED:
        raise ValueError(f"{name} is a metric of the library")
    _REGISTERED[name] = expression
    if name not in METRICS:
        METRICS.append(name)


def forget_metric(name: str) -> None:
    """Undo :func:`register_metric`."""
    if _REGISTERED.pop(name, None) is not None:
        METRICS.remove(name)


def metric_columns(truth: Column, prediction: Column, suffix: str = "") -> list[Column]:
    """The four metrics as aggregate expressions.

    The total sum of squares is the built-in population variance, which merges partial
    results stably; a constant truth scores 1 when predicted exactly and 0 otherwise.
    """
    both = truth.isNotNull() & prediction.isNotNull()
    y = F.when(both, truth.cast("double"))
    error = F.when(both, truth - prediction).cast("double")
    mse = F.avg(error * error)
    spread = F.var_pop(y)
    r2 = F.when(spread > 0, 1 - mse / spread).when(F.count(y) > 1, (mse == 0).cast("double"))
    return [
        r2.alias(f"r2{suffix}"),
        F.avg(F.abs(error)).alias(f"mae{suffix}"),
        mse.alias(f"mse{suffix}"),
        F.sqrt(mse).alias(f"rmse{suffix}"),
        *[f(y, F.when(both, prediction.cast("double"))).alias(f"{name}{suffix}") for name, f in _REGISTERED.items()],
    ]


def regression_metrics(
    df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = (), raw: str | None = None
) -> DataFrame:
    """r2, mae, mse and rmse per group, and with ``raw`` also after adding the raw value to both sides."""
    y, p = F.col(truth), F.col(prediction)
    columns = metric_columns(y, p)
    if raw is not None:
        columns += metric_columns(y + F.col(raw), p + F.col(raw), "_sum_back")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *columns)


def metrics_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per metric, column ``score``."""
    return wide.unpivot(list(keys), METRICS, "metric", "score")


def linear_scaling(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept of the truth on the prediction."""
    y, p = F.col(truth), F.col(prediction)
    fitted = df.groupBy(*keys).agg(
        (F.covar_samp(y, p) / (F.var_pop(p) + 1e-12)).alias("slope"), F.avg(y).alias("_y"), F.avg(p).alias("_p")
    )
    return fitted.select(*keys, "slope", (F.col("_y") - F.col("slope") * F.col("_p")).alias("intercept"))


def threshold_sweep(
    df: DataFrame, truth: str, distance: str, near: str, far: str, thresholds: Sequence[float]
) -> DataFrame:
    """Score a near/far model pair for every distance threshold in one pass."""
    choices = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.when(F.col(distance) <= t, F.col(near)).when(F.col(distance) > t, F.col(far)).otherwise(0.0).alias("p"),
            )
            for t in thresholds
        ]
    )
    spread = df.select(F.col(truth).alias("_y"), F.explode(choices).alias("_c"))
    return spread.groupBy(F.col("_c.threshold").alias("threshold")).agg(
        F.count("*").alias("n"), *metric_columns(F.col("_y"), F.col("_c.p"))
    )


def rank_candidates(df: DataFrame, truth: str, candidates: dict[str, Column], metric: str = "rmse") -> DataFrame:
    """Score many candidate formulas in one scan and rank them by error."""
    aggs = []
    for i, formula in enumerate(candidates.values()):
        aggs += metric_columns(F.col(truth), formula, f"_{i}")
    wide = df.agg(*aggs)
    per_candidate = F.array(
        *[
            F.struct(F.lit(name).alias("candidate"), *[F.col(f"{m}_{i}").alias(m) for m in METRICS])
            for i, name in enumerate(candidates)
        ]
    )
    scores = wide.select(F.inline(per_candidate))
    best_first = F.desc(metric) if metric == "r2" else F.asc(metric)
    # one row per candidate: the window is over a handful of rows
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(best_first, "candidate")))
