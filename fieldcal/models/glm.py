"""Gamma and Poisson regression with a log link, for many settings at once.

Every round of re-weighted least squares is one pass over the rows, whatever the number of settings: each task adds up one
weighted block of cross products for each penalty, Spark sums the blocks, and the small systems are solved on the driver.
Settings that differ only in the number of rounds are points on the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.models.blocks import SCHEMA, added, block_rows, matrix
from fieldcal.models.elasticnet import LinearFit


@dataclass
class LogLinear:
    """Exponential of a linear model."""

    line: LinearFit

    def column(self, features: Column) -> Column:
        return F.exp(self.line.column(features))

    def transform(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.column(vector_to_array(F.col(features))))


def _round(batches: Iterator[pa.RecordBatch], family: str, ways: dict[int, np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """y, x → per way the cross products of x, 1 and the working response, under the weights of the way's coefficients."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        y = batch.column(0).to_numpy(zero_copy_only=False)
        a = np.column_stack([matrix(batch.column(1), n), np.ones(n)])
        for i, c in ways.items():
            mu = np.maximum(y, 0.1 if family == "poisson" else 1e-16) if c is None else np.exp(a @ c)
            w = mu if family == "poisson" else np.ones(n)
            b = np.column_stack([a, np.log(mu) + (y - mu) / mu])
            total[i] = total.get(i, 0.0) + (b.T @ (w[:, None] * b)).ravel()
    if total:
        yield block_rows(total)


def fit_glms(
    ready: DataFrame, family: str, settings: Sequence[Mapping[str, Any]], features: str = "features", label: str = "label"
) -> list[LogLinear]:
    """One model for each setting (regParam, maxIter, tol), in the order of the settings."""
    if family not in ("gamma", "poisson"):
        raise ValueError("choose the family 'gamma' or 'poisson'")
    rows = ready.select(F.col(label).cast("double").alias("y"), vector_to_array(F.col(features)).alias("x"))
    penalties = sorted({float(s.get("regParam", 0.0)) for s in settings})
    longest = {p: max(int(s.get("maxIter", 25)) for s in settings if float(s.get("regParam", 0.0)) == p) for p in penalties}
    tol = min(float(s.get("tol", 1e-6)) for s in settings)
    ways: list[list[np.ndarray]] = [[] for _ in penalties]  # coefficients after each round
    open_ways = list(range(len(penalties)))
    while open_ways:
        now = {i: (ways[i][-1] if ways[i] else None) for i in open_ways}
        blocks = added(rows.mapInArrow(lambda b: _round(b, family, now), SCHEMA))
        if not blocks:
            raise ValueError("no rows to fit")
        for i in list(open_ways):
            size = int(np.sqrt(len(blocks[i])))
            m = blocks[i].reshape(size, size)
            m = m / m[-2, -2]  # by the sum of the weights
            left = m[:-1, :-1] + np.diag([penalties[i]] * (size - 2) + [0.0])
            c = np.linalg.lstsq(left, m[:-1, -1], rcond=None)[0]
            moved = np.inf if not ways[i] else np.abs(c - ways[i][-1]).max()
            ways[i].append(c)
            if moved <= tol or len(ways[i]) >= longest[penalties[i]]:
                open_ways.remove(i)
    out = []
    for s in settings:
        way = ways[penalties.index(float(s.get("regParam", 0.0)))]
        c = way[min(len(way), int(s.get("maxIter", 25))) - 1]
        out.append(LogLinear(LinearFit([float(v) for v in c[:-1]], float(c[-1]), float(s.get("regParam", 0.0)))))
    return out
