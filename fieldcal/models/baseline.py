"""Baselines: the raw sensor value, alone or shifted by a median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.operators.quantiles import exact_quantiles
from fieldcal.session import join_lookup, stored


def raw_prediction(df: DataFrame, raw: str, output: str = "prediction") -> DataFrame:
    return df.withColumn(output, F.col(raw).cast("double"))


def median_of_target(train: DataFrame, target: str) -> float:
    return exact_quantiles(train, target, {"median": 0.5}).first()["median"]


def median_of_delta(train: DataFrame, target: str, raw: str) -> float:
    return exact_quantiles(train.select((F.col(target) - F.col(raw)).alias("d")), "d", {"median": 0.5}).first()["median"]


def shifted_prediction(df: DataFrame, raw: str, offset: float, output: str = "prediction") -> DataFrame:
    return df.withColumn(output, F.col(raw) + F.lit(float(offset)))


def group_offsets(train: DataFrame, target: str, raw: str, groups: Sequence[str]) -> DataFrame:
    """Median of target minus raw per group, column ``offset``."""
    return offsets_with_total(train, target, raw, groups)[0]


def offsets_with_total(train: DataFrame, target: str, raw: str, groups: Sequence[str]) -> tuple[DataFrame, float | None]:
    """Median of target minus raw per group, column ``offset``, and over all rows, from the same two scans.

    Every row counts once for its group and once for the total; rows with a NULL in their group only for the total. The
    result is written, so that both parts read it; it belongs to the fitted model, not to the steps of a fit. Without rows the
    total is None.
    """
    whole = F.lit(True)
    for name in groups:
        whole = whole & F.col(name).isNotNull()
    key = F.struct(*[F.col(name) for name in groups])
    sets = F.filter(F.array(F.struct(F.lit(True).alias("total"), F.when(F.lit(False), key).alias("of")),
                            F.struct(F.lit(False).alias("total"), F.when(whole, key).alias("of"))),
                    lambda x: x["total"] | x["of"].isNotNull())
    delta = train.select(F.explode(sets).alias("set"), (F.col(target) - F.col(raw)).alias("d"))
    medians = stored(exact_quantiles(delta, "d", {"offset": 0.5}, ["set"]).select("set", "offset"), "offsets", keep=True)
    total = medians.where("set.total").first()
    offsets = medians.where("not set.total").select(*[F.col("set.of").getField(name).alias(name) for name in groups], "offset")
    return offsets, None if total is None else total["offset"]


def grouped_prediction(
    df: DataFrame, raw: str, offsets: DataFrame, groups: Sequence[str], fallback: float, output: str = "prediction"
) -> DataFrame:
    """Raw value plus the offset of the row's group; groups unseen in training take the global median."""
    looked_up = join_lookup(df, offsets, groups, "left")
    prediction = F.col(raw) + F.coalesce("offset", F.lit(float(fallback)))
    return looked_up.select(*df.columns, prediction.alias(output))
