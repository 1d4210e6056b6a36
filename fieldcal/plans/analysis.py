"""Analysis of many runs: ensembles, quantiles over seeds, best models, boxplots, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.functions.geo import mercator_x, mercator_y
from fieldcal.functions.measure import replace_zero
from fieldcal.functions.text import model_label
from fieldcal.operators.eda import seed_score_summary
from fieldcal.operators.hull import bounding_boxes, convex_hulls, shared_scale
from fieldcal.operators.metrics import metric_columns, metrics_long
from fieldcal.operators.quantiles import QUARTILES, bounded_quantiles
from fieldcal.operators.reshape import cap_rows
from fieldcal.operators.ranktests import holm_winners, mann_whitney_pairs, wilcoxon_signed_rank


def ensemble_quantiles(predictions: DataFrame, row_key: Sequence[str], value: str = "prediction") -> DataFrame:
    """Median, quartiles and their distance per row over the models of an ensemble, in long form."""
    return bounded_quantiles(predictions, value, QUARTILES, row_key).withColumn("iqr", F.col("q3") - F.col("q1"))


def ensemble_columns(df: DataFrame, predictions: Sequence[Column]) -> DataFrame:
    """The same for models that are columns of one row: sorted in place, no shuffle.

    The number of models is the length of the array, fixed by the ensemble.
    """
    ordered = df.withColumn("_p", F.array_sort(F.array(*predictions)))
    n = len(predictions)

    def at(p: float) -> Column:
        h = (n - 1) * p
        low = int(h)
        a, b = F.col("_p")[low], F.col("_p")[min(low + 1, n - 1)]
        return a + (b - a) * F.lit(h - low)

    quartiles = {name: at(p) for name, p in QUARTILES.items()}
    return ordered.withColumns(quartiles).withColumn("iqr", F.col("q3") - F.col("q1")).drop("_p")


def ensemble_of_models(models: Sequence[Transformer], df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Apply every fitted model to the rows and add the median, quartiles and their distance."""
    names = [f"_ensemble_{i}" for i in range(len(models))]
    scored = df
    for name, model in zip(names, models):
        scored = model.transform(scored).withColumnRenamed(prediction, name)
    return ensemble_columns(scored, [F.col(n) for n in names]).drop(*names)


def seed_quantiles(scores: DataFrame, keys: Sequence[str] = ("model", "metric", "split")) -> DataFrame:
    """Quartiles over seeds per model, metric and split."""
    return bounded_quantiles(scores, "score", QUARTILES, keys)


def median_scores(scores: DataFrame, keys: Sequence[str] = ("model", "zone", "metric", "split"), digits: int = 2) -> DataFrame:
    return scores.groupBy(*keys).agg(F.round(F.median("score"), digits).alias("score"))


def learning_curve(scores: DataFrame, size: str = "n_train_records") -> DataFrame:
    """Quartiles of the error by training size and split; size 0 means all rows."""
    label = F.when(F.col(size) == 0, "max").otherwise(F.col(size).cast("string"))
    return bounded_quantiles(scores, "score", QUARTILES, [size, "split"]).withColumn("label", label)


def best_model_table(scores: DataFrame, digits: int = 2) -> DataFrame:
    """Rounded median test score per model, zone and metric, all best ones marked.

    Lowest is best for errors, highest for r2; equal rounded scores are all marked.
    """
    medians = median_scores(scores.where("split = 'test'"), ["zone", "metric", "model"], digits)
    group = Window.partitionBy("zone", "metric")
    best = F.when(F.col("metric") == "r2", F.max("score").over(group)).otherwise(F.min("score").over(group))
    return medians.select(
        "zone", "metric", "model", model_label(F.col("model")).alias("label"), "score", (F.col("score") == best).alias("best")
    )


def boxplot_scores(scores: DataFrame, main_zone: str, metric: str = "mae") -> DataFrame:
    """Score distribution per zone, model and split; training scores only for the main zone."""
    kept = scores.where(
        (F.col("metric") == metric) & ((F.col("split") == "test") | (F.col("zone") == main_zone))
    )
    return seed_score_summary(kept, "score", "seed_index", ["zone", "model", "split"])


def significance_marks(
    scores: DataFrame, models: Sequence[str], metric: str = "mae", alpha: float = 0.05
) -> DataFrame:
    """Per zone and model: does it beat all others (Holm), any other, and is it the first that beats all?"""
    test = scores.where((F.col("metric") == metric) & (F.col("split") == "test"))
    pairs = mann_whitney_pairs(test, "score", "model", models, "less", ["zone"], alpha)
    winners = holm_winners(pairs, ["zone"], alpha)
    # one row per model and zone: the first winner is the smallest place among the winners of the zone
    first = F.min(F.when(F.col("holm"), F.col("method_order"))).over(Window.partitionBy("zone"))
    return winners.select(
        "zone", F.col("method").alias("model"), "holm",
        (F.col("holm") | F.col("any_significant")).alias("marked"),
        F.coalesce(F.col("method_order") == first, F.lit(False)).alias("first_holm"),
    )


def zone_mean_std(df: DataFrame, columns: Sequence[str], zone: str = "zone", digits: int = 4) -> DataFrame:
    """Mean and population deviation of each column per zone."""
    aggs = []
    for c in columns:
        aggs += [
            F.round(F.avg(c), digits).alias(f"{c}_mean"),
            F.round(F.stddev_pop(c), digits).alias(f"{c}_std"),
        ]
    return df.groupBy(zone).agg(*aggs)


def capped_score_table(
    predictions: DataFrame, target: str, y_cap: float | None = None, feature: str | None = None,
    feature_cap: float | None = None, prediction: str = "prediction",
) -> DataFrame:
    """Quartiles over seeds of every metric per model and split, on rows at or below the caps.

    Exact zeros of the training target count as 1e-8, as they did when the models were fitted.
    """
    y = F.when(F.col("split") == "train", replace_zero(F.col(target))).otherwise(F.col(target))
    kept = cap_rows(predictions.withColumn(target, y), target, y_cap, feature, feature_cap)
    keys = ["model", "seed_index", "split"]
    per_seed = kept.groupBy(*keys).agg(*metric_columns(F.col(target), F.col(prediction)))
    return seed_quantiles(metrics_long(per_seed, keys))


def map_layers(df: DataFrame, zone: str, lon: str, lat: str, values: Sequence[str]) -> dict[str, DataFrame]:
    """Map data by layer: points with lower values first, the shared colour scale, boxes and hulls."""
    points = df.select(
        zone, mercator_x(F.col(lon)).alias("x"), mercator_y(F.col(lat)).alias("y"), *values
    )
    return {
        "points": points.orderBy(*values),
        "scale": shared_scale(df, values),
        "boxes": bounding_boxes(df, zone, lon, lat),
        "hulls": convex_hulls(points, zone, "x", "y"),
    }


def zone_comparison(df: DataFrame, raw: str, official: str, model: str, zone: str = "zone") -> DataFrame:
    """Signed-rank tests between raw, official and model values per zone."""
    pairs = [(raw, official), (official, model), (raw, model)]
    tests = F.array(
        *[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y"))
            for a, b in pairs
        ]
    )
    spread = df.select(F.col(zone), F.inline(tests))
    return wilcoxon_signed_rank(spread, "x", "y", [zone, "first", "second"])


def experiment_plan(grid: DataFrame, names: Sequence[str], sep: str = ";") -> DataFrame:
    """Run lines ``key;value;…`` with sorted keys."""
    parts = [F.concat_ws(sep, F.lit(n), F.col(n).cast("string")) for n in sorted(names)]
    return grid.withColumn("line", F.concat_ws(sep, *parts))
