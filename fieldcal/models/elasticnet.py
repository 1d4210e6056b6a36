"""Elastic net with a cross-validated penalty.

One aggregation gives the moments of every fold; the whole penalty path of every fold is then
solved from those small matrices, without another pass over the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.models.blocks import SCHEMA, added, block_rows, matrix


@dataclass
class LinearFit:
    """A linear model on a feature vector; adds its prediction as a column expression."""

    coefficients: list[float]
    intercept: float
    penalty: float | None = None

    def column(self, features: Column) -> Column:
        """The prediction, from an array of features."""
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        dot = F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t)
        return dot + F.lit(float(self.intercept))

    def transform(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.column(vector_to_array(F.col(features))))


def _moment_parts(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Fold, label, features → per fold of the task: count, sums and cross products as one vector."""
    p = len(shift)
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        fold = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(fold):
            continue
        z = np.column_stack([batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(2), len(fold))]) - shift
        for f in np.unique(fold):
            rows = z[fold == f]
            total = parts.setdefault(int(f), np.zeros(1 + p + p * p))
            total += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
    if parts:
        yield block_rows(parts)


def fold_moments(df: DataFrame, features: str, label: str, fold: str, shift: np.ndarray) -> dict[int, tuple]:
    """Per fold: row count, sums and cross products of label and features, all moved by ``shift``.

    Any row of the data will do as the shift; it keeps the sums free of large cancelling parts. Each task makes one
    Gram block per fold; blocks are added up by Spark, first in groups of tasks.
    """
    p = len(shift)
    rows = df.select(
        F.col(fold).cast("int").alias("f"), F.col(label).cast("double").alias("y"), vector_to_array(F.col(features)).alias("x")
    )
    blocks = added(rows.mapInArrow(lambda b: _moment_parts(b, shift), SCHEMA))
    return {f: (int(m[0]), m[1 : 1 + p], m[1 + p :].reshape(p, p)) for f, m in blocks.items()}


def _centred(n: float, s: np.ndarray, m: np.ndarray):
    mean = s / n
    return mean, m - n * np.outer(mean, mean)


_SWEEPS = 20


def _polished(gram: np.ndarray, xy: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """The exact solution with the signs of ``w``, if these are the right ones."""
    some = np.flatnonzero(w)
    out = np.zeros(len(w))
    if len(some):
        left = gram[np.ix_(some, some)] + l2 * np.eye(len(some))
        out[some] = np.linalg.lstsq(left, xy[some] - l1 * np.sign(w[some]), rcond=None)[0]
        if (np.sign(out[some]) != np.sign(w[some])).any():
            return None
    pull = xy - gram @ out - l2 * out
    off = np.where(out == 0, np.maximum(np.abs(pull) - l1, 0.0), np.abs(pull - l1 * np.sign(out)))
    return out if off.max(initial=0.0) <= 1e-9 * max(1e-300, np.abs(xy).max(initial=0.0)) else None


def _paths(grams, xys, ns, penalties, l1_ratio, tol=1e-9, max_iter=4000) -> np.ndarray:
    """Coordinate descent on the moments of all data sets and for all penalties at once: set, penalty, feature.

    After some sweeps each problem's signs are tried for its exact solution; problems that have it take no further part.
    """
    sets, p = xys.shape
    of = np.repeat(np.arange(sets), len(penalties))  # the set of each problem
    l1 = np.tile(penalties, sets) * l1_ratio * ns[of]
    l2 = np.tile(penalties, sets) * (1 - l1_ratio) * ns[of]
    w = np.zeros((len(of), p))
    left = np.arange(len(of))
    now, fitted = w[left], np.zeros((len(left), p))  # fitted: gram @ now, kept up to date
    for sweep in range(1, max_iter + 1):
        moved = np.zeros(len(left))
        which = of[left]
        for j in range(p):
            size = grams[which, j, j] + l2[left]
            rho = xys[which, j] - fitted[:, j] + grams[which, j, j] * now[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - l1[left], 0.0) / np.where(size > 0, size, 1.0)
            step = np.where(size > 0, new - now[:, j], 0.0)
            now[:, j] += step
            fitted += step[:, None] * grams[which, j, :]
            moved = np.maximum(moved, np.abs(step))
        if sweep % _SWEEPS == 0 or sweep == max_iter:
            found = [_polished(grams[of[k]], xys[of[k]], now[i], l1[k], l2[k]) for i, k in enumerate(left)]
            still = moved <= tol * np.maximum(1.0, np.abs(now).max(axis=1, initial=0.0))
            for i, k in enumerate(left):
                w[k] = now[i] if found[i] is None else found[i]
            on = np.array([f is None for f in found]) & ~still
            left, now, fitted = left[on], now[on], fitted[on]
            if not len(left):
                break
    return w.reshape(sets, len(penalties), p)


class FoldMoments:
    """Moments of the folds of a table, from one pass; every setting is then solved from them."""

    def __init__(self, df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold"):
        first = df.select(features, F.col(label).cast("double")).first()
        if first is None:
            raise ValueError("no rows to fit")
        self.shift = np.concatenate([[first[1]], first[0].toArray()])
        folds = fold_moments(df, features, label, fold, self.shift)
        self.held = [folds[f] for f in sorted(folds)]
        whole = tuple(sum(f[i] for f in self.held) for i in range(3))
        sets = [whole, *[tuple(whole[i] - f[i] for i in range(3)) for f in self.held]]  # all rows, then without each fold
        self.n = np.array([s[0] for s in sets], dtype=float)
        self.means, self.cross = (np.array(v) for v in zip(*[_centred(*s) for s in sets]))

    def fit(self, l1_ratio: float = 0.5, n_alphas: int = 100, eps: float = 1e-3) -> LinearFit:
        """Choose the penalty by the mean squared error over the folds, on all rows.

        An ``l1_ratio`` of 0 has no natural largest penalty; 0.001 stands in for it when the path is laid out.
        """
        grams, xys = self.cross[:, 1:, 1:], self.cross[:, 0, 1:]
        top = np.abs(xys[0]).max(initial=0.0) / (self.n[0] * max(l1_ratio, 1e-3))
        if top == 0:
            return LinearFit([0.0] * xys.shape[1], float(self.means[0, 0] + self.shift[0]), 0.0)
        penalties = top * np.power(eps, np.arange(n_alphas) / max(1, n_alphas - 1))
        paths = _paths(grams, xys, self.n, penalties, l1_ratio)
        errors = np.zeros(len(penalties))
        for (n, s, m), mean, ws in zip(self.held, self.means[1:], paths[1:]):
            b = mean[0] - ws @ mean[1:]
            v = np.column_stack([np.ones(len(ws)), -ws])  # residual = v . z - b
            errors += (np.einsum("ij,jk,ik->i", v, m, v) - 2 * b * (v @ s) + n * b * b) / n
        best = int(np.argmin(errors))
        w, z_mean = paths[0, best], self.means[0] + self.shift
        return LinearFit([float(c) for c in w], float(z_mean[0] - w @ z_mean[1:]), float(penalties[best]))


def fit_elasticnet_cv(
    df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold", l1_ratio: float = 0.5, n_alphas: int = 100, eps: float = 1e-3
) -> LinearFit:
    """Elastic net of one setting, see :class:`FoldMoments`."""
    return FoldMoments(df, features, label, fold).fit(l1_ratio, n_alphas, eps)
