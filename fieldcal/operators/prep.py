"""Feature preparation: scaling, one-hot pipelines, rare-target augmentation, un-scaling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.operators.quantiles import QUARTILES, column_quantiles, exact_quantiles

Scaling = dict[str, tuple[float, float]]


def fit_scaling(df: DataFrame, columns: Sequence[str], strategy: str) -> Scaling:
    """Centre and scale per column (one small row per column on the driver).

    standard: mean and population deviation; minmax: minimum and range; robust: median and
    interquartile range; none: identity. A spread of zero becomes 1, so constants map to 0.
    """
    columns = list(columns)
    if strategy == "none" or not columns:
        return {c: (0.0, 1.0) for c in columns}
    if strategy == "robust":
        rows = {r["column"]: r for r in column_quantiles(df, columns, QUARTILES).collect()}
        fitted = {c: (rows[c]["median"], rows[c]["q3"] - rows[c]["q1"]) for c in columns}
    elif strategy in ("standard", "minmax"):
        pair = {
            "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
            "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        }[strategy]
        aggs = [a.cast("double").alias(f"{c}{i}") for c in columns for i, a in enumerate(pair(c))]
        row = df.agg(*aggs).first()
        fitted = {c: (row[f"{c}0"], row[f"{c}1"]) for c in columns}
    else:
        raise ValueError("choose 'standard', 'minmax', 'robust' or 'none'")
    return {c: (center, scale if scale else 1.0) for c, (center, scale) in fitted.items()}


def apply_scaling(df: DataFrame, scaling: Scaling) -> DataFrame:
    return df.withColumns({c: (F.col(c) - center) / scale for c, (center, scale) in scaling.items()})


def feature_stages(categorical: Sequence[str], numeric: Sequence[str], output: str = "features") -> list:
    """ML stages: one-hot categories (unseen → all zeros) before the numbers, in one vector.

    The indexer keeps one extra slot for unseen categories and the encoder drops that last slot,
    which leaves exactly one slot per known category.
    """
    stages: list = []
    if categorical:
        indexed = [f"{c}__index" for c in categorical]
        encoded = [f"{c}__onehot" for c in categorical]
        stages.append(
            StringIndexer(
                inputCols=list(categorical), outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error"))
    else:
        encoded = []
    stages.append(VectorAssembler(inputCols=[*encoded, *numeric], outputCol=output, handleInvalid="error"))
    return stages


def feature_pipeline(categorical: Sequence[str], numeric: Sequence[str], output: str = "features") -> Pipeline:
    return Pipeline(stages=feature_stages(categorical, numeric, output))


def _uniform(seed: int, salt: str, key: Column) -> Column:
    """Uniform number in (0, 1) from a hash: the same on every engine and for every partitioning."""
    bits = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key)), F.lit(12)), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**48)


def gaussian_noise(seed: int, salt: str, key: Column, sd: float) -> Column:
    """Normal noise by the Box-Muller transform of two hashed uniform numbers."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(_uniform(seed, salt + "/r", key)))
    return F.lit(float(sd)) * radius * F.cos(F.lit(2 * math.pi) * _uniform(seed, salt + "/a", key))


def augment_rare(
    df: DataFrame, target: str, numeric: Sequence[str], key: Column, share: float, copies: int,
    x_noise: float = 0.0, y_noise: float = 0.0, seed: int = 0,
) -> DataFrame:
    """Append ``copies`` noisy copies of the rows above a target percentile.

    The threshold is the ``int(share * 100)``-th percentile. With target noise, negative
    targets become 0. ``copy`` is 0 for original rows.
    """
    percent = int(share * 100) / 100.0
    limit = exact_quantiles(df, target, {"limit": percent}).first()["limit"]
    rare = df.where(F.col(target) > limit).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    row_key = F.concat_ws("|", key, F.col("copy").cast("string"))
    noisy = {}
    if x_noise > 0:
        noisy = {c: F.col(c) + gaussian_noise(seed, c, row_key, x_noise) for c in numeric}
    if y_noise > 0:
        noisy[target] = F.col(target) + gaussian_noise(seed, target, row_key, y_noise)
    both = df.withColumn("copy", F.lit(0)).unionByName(rare.withColumns(noisy) if noisy else rare)
    if y_noise > 0:
        both = both.withColumn(target, F.greatest(F.col(target), F.lit(0.0)))
    return both


def augment(df: DataFrame, mode: str, target: str, numeric: Sequence[str], key: Column, seed: int) -> DataFrame:
    """``none`` or ``simple_<share>_<copies>_<xnoise>_<ynoise>``."""
    if mode == "none":
        return df
    if mode.startswith("simple"):
        _, share, copies, x_noise, y_noise = mode.split("_")
        made = augment_rare(
            df, target, numeric, key, float(share), int(copies), float(x_noise), float(y_noise), seed
        )
        return made.drop("copy")
    raise ValueError("choose 'simple_…' or 'none'")


def unscale_linear(coefficients: Mapping[str, float], intercept: float, scaling: Scaling) -> tuple[dict[str, float], float]:
    """Coefficients and intercept on raw features: c / scale, and intercept minus the sum of c * centre / scale."""
    raw = {c: v / scaling.get(c, (0.0, 1.0))[1] for c, v in coefficients.items()}
    return raw, intercept - sum(raw[c] * scaling.get(c, (0.0, 1.0))[0] for c in raw)


def linear_expression(coefficients: Mapping[str, float], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for name, c in coefficients.items():
        total = total + F.lit(float(c)) * F.col(name)
    return total
