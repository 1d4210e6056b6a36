"""AdaBoost.R2: re-weighted trees and a weighted-median vote, weights kept as a column."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.session import durable

_CHECKPOINT_EVERY = 5


@dataclass
class BoostedMedian:
    trees: list[DecisionTreeRegressionModel]
    weights: list[float]

    def transform(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        """Weighted median of the tree predictions: the first, in value order, that reaches half the weight."""
        names = [f"_vote{i}" for i in range(len(self.trees))]
        voted = df
        for name, tree in zip(names, self.trees):
            voted = tree.copy({tree.predictionCol: name, tree.featuresCol: features}).transform(voted)
        votes = F.array_sort(
            F.array(*[F.struct(F.col(n).alias("p"), F.lit(w).alias("w")) for n, w in zip(names, self.weights)])
        )
        half = sum(self.weights) / 2
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("p"))

        def step(acc: Column, vote: Column) -> Column:
            seen = acc["seen"] + vote["w"]
            return F.struct(seen.alias("seen"), F.coalesce(acc["p"], F.when(seen >= half, vote["p"])).alias("p"))

        chosen = F.aggregate(votes, start, step, lambda acc: acc["p"])
        return voted.withColumn(output, F.coalesce(chosen, F.element_at(votes, -1)["p"])).drop(*names)


def _loss(error: Column, kind: str) -> Column:
    if kind == "linear":
        return error
    if kind == "square":
        return error * error
    if kind == "exponential":
        return 1 - F.exp(-error)
    raise ValueError("choose the loss 'linear', 'square' or 'exponential'")


def fit_adaboost_r2(
    df: DataFrame, features: str = "features", label: str = "label", n_estimators: int = 50,
    learning_rate: float = 1.0, loss: str = "linear", max_depth: int = 3, seed: int = 0,
) -> BoostedMedian:
    """Fit on weights instead of weighted re-samples; every round is two passes and one tree fit."""
    rows = df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"))
    rows = durable(rows.withColumn("w", F.lit(1.0)))
    total = rows.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("no rows to fit")
    trees, weights = [], []
    for i in range(n_estimators):
        tree = DecisionTreeRegressor(maxDepth=max_depth, weightCol="w", seed=seed + i).fit(rows)
        scored = tree.transform(rows).withColumn("_e", F.abs(F.col("label") - F.col("prediction")))
        largest = scored.agg(F.max("_e")).first()[0]
        if largest == 0:
            trees.append(tree)
            weights.append(1.0)
            break
        cost = _loss(F.col("_e") / largest, loss)
        average = scored.agg(F.sum(F.col("w") * cost) / F.sum("w")).first()[0]
        if average >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = average / (1 - average)
        trees.append(tree)
        weights.append(learning_rate * math.log(1 / beta))
        if i + 1 == n_estimators:
            break
        reweighted = scored.select(
            "features", "label", (F.col("w") * F.pow(F.lit(beta), (1 - cost) * learning_rate)).alias("w")
        )
        rows = reweighted
        if (i + 1) % _CHECKPOINT_EVERY == 0:  # only ratios of weights matter: bring them back to their size here
            rows = durable(reweighted)
            rows = rows.withColumn("w", F.col("w") * (total / rows.agg(F.sum("w")).first()[0]))
    return BoostedMedian(trees, weights)
