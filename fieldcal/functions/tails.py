"""Tail probabilities for test results. Applied to result rows only, one row per test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _chi2_tail(x: float, k: float) -> float:
    """Upper tail of the chi-square law: series below the mean, continued fraction above."""
    a, z = k / 2.0, x / 2.0
    if not math.isfinite(z) or z <= 0:
        return 1.0 if z <= 0 else 0.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _small_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) for untied samples, by counting rank arrangements."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    for i in range(1, n1 + 1):  # generating function prod (1 - x^(n2+i)) / (1 - x^i)
        step = n2 + i
        counts[step:] -= counts[:-step].copy() if step < len(counts) else 0
        width = -(-len(counts) // i) * i
        counts = np.pad(counts, (0, width - len(counts))).reshape(-1, i).cumsum(axis=0).ravel()[: len(counts)]
    return float(counts[int(math.ceil(u)):].sum() / counts.sum())


def _small_signed_tail(n: int, t: float) -> float:
    """P(T+ >= t) for n untied non-zero differences."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for i in range(1, n + 1):
        shifted = np.zeros_like(counts)
        shifted[i:] = counts[:-i]
        counts = counts + shifted
    return float(counts[int(math.ceil(t)):].sum() / counts.sum())


def _fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of all table probabilities not above that of the observed table.

    The law has one peak, so the far edge is found by bisection and only terms that matter
    are added, in blocks; the work grows with the spread, not with the counts.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    if lo == hi:
        return 1.0
    lgamma = np.vectorize(math.lgamma, otypes=[float])

    def log_p(x):
        x = np.asarray(x, dtype=float)
        return (
            math.lgamma(row + 1) + math.lgamma(n - row + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1)
            - math.lgamma(n + 1)
            - lgamma(x + 1) - lgamma(row - x + 1) - lgamma(col - x + 1) - lgamma(n - row - col + x + 1)
        )

    limit = float(log_p(a)) + 1e-7
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))

    def tail(start: int, stop: int, step: int) -> float:
        total, x = 0.0, start
        while (x - stop) * step <= 0:
            block = np.arange(x, x + step * 4096, step)
            block = block[(block - stop) * step <= 0]
            p = np.exp(log_p(block))
            total += float(p.sum())
            if p[-1] < total * 1e-18:
                break
            x += step * 4096
        return total

    def first_small(inner: int, outer: int) -> int | None:
        """Closest point to the mode, on one side, whose probability is not above the limit."""
        if float(log_p(outer)) > limit:
            return None
        step = 1 if outer >= inner else -1
        good, bad = outer, inner - step
        while abs(good - bad) > 1:
            middle = (good + bad) // 2
            if float(log_p(middle)) <= limit:
                good = middle
            else:
                bad = middle
        return good

    left = first_small(mode, lo)
    right = first_small(mode + 1, hi) if mode < hi else None
    p = (tail(left, lo, -1) if left is not None else 0.0) + (tail(right, hi, 1) if right is not None else 0.0)
    return min(1.0, p)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else _chi2_tail(float(a), float(b)) for a, b in zip(x, k)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return pd.Series([None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)) for v in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def mann_whitney_small_tail(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(c) else _small_u_tail(int(min(a, b)), int(max(a, b)), float(c)) for a, b, c in zip(n1, n2, u)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def signed_rank_small_tail(n: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(b) else _small_signed_tail(int(a), float(b)) for a, b in zip(n, t)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    rows = zip(a, b, c, d)
    return pd.Series([None if any(map(pd.isna, r)) else _fisher_two_sided(*map(int, r)) for r in rows], dtype="float64")
