"""Rank-based and contingency tests for samples of any size.

Equal values are collapsed first (value, count per sample), with map-side combine, so the
data is never ranked row by row. The distinct values are range-partitioned; every range
adds up its own part of all pair statistics and one small row per range carries the
offsets. No window ever spans a whole test.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.functions.tails import (
    chi2_tail,
    fisher_two_sided,
    mann_whitney_small_tail,
    normal_tail,
    signed_rank_small_tail,
)

_SMALL_SAMPLE = 8
_SMALL_SIGNED = 50


class _RangeSums:
    """What one test has so far in a range: all of it adds up batch by batch."""

    def __init__(self, part: int, keys: list[pa.Array], k: int):
        self.part, self.keys = part, keys
        self.s, self.l, self.q, self.g, self.t = np.zeros(k), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k * k), 0.0

    def add(self, c: np.ndarray) -> None:
        """Counts per sample of the next values, in order."""
        k = c.shape[1]
        below = self.s + np.cumsum(c, axis=0) - c
        whole = c.sum(axis=1)
        self.l += c.T @ (below + c / 2)
        self.q += (c * c).T @ c
        self.g += np.concatenate([np.abs(c - c[:, [i]]).sum(axis=0) for i in range(k)])
        self.t += float((whole**3 - whole).sum())
        self.s += c.sum(axis=0)

    def row(self, names: list[str]) -> pa.RecordBatch:
        sums = [self.s.tolist(), self.l.ravel().tolist(), self.q.ravel().tolist(), self.g.tolist(), self.t]
        return pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), *self.keys, *[pa.array([x]) for x in sums]], names)


def _range_parts(batches: Iterator[pa.RecordBatch], k: int, n_keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, keys, value, counts) of one range → one row for each test of the range.

    Sums of the counts, pairs within the range, the products that tie sums need, and distances between samples. One batch
    is held at a time; a test that goes on in the next batch goes on with its sums.
    """
    sums, last, names = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ["_part", *batch.schema.names[1 : 1 + n_keys], "s", "l", "q", "g", "t"]
        counts = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        keys = list(zip(*[batch.column(1 + i).to_pylist() for i in range(n_keys)])) if n_keys else [()] * len(counts)
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            if sums is None or keys[start] != last:
                if sums is not None:
                    yield sums.row(names)
                part = batch.column(0)[start].as_py()
                sums, last = _RangeSums(part, [batch.column(1 + i).slice(start, 1) for i in range(n_keys)], k), keys[start]
            sums.add(counts[start:end])
    if sums is not None:
        yield sums.row(names)


def _join_ranges(table: pa.Table, k: int, n_keys: int) -> pa.Table:
    """All ranges of one test → its statistics; one row per range."""
    order = np.argsort(table.column("_part").to_numpy())
    s, l, q, g = (np.array(table.column(c).to_pylist())[order] for c in ("s", "l", "q", "g"))
    offset = np.cumsum(s, axis=0) - s
    u = l.reshape(-1, k, k) + s[:, :, None] * offset[:, None, :]
    n, q, gap = s.sum(axis=0), q.sum(axis=0).reshape(k, k), g.sum(axis=0)
    cubes = np.diag(q)
    tie = cubes[:, None] + cubes[None, :] + 3 * (q + q.T) - (n[:, None] + n[None, :])
    values = [n.tolist(), u.sum(axis=0).ravel().tolist(), tie.ravel().tolist(), gap.tolist()]
    columns = [table.column(1 + i).slice(0, 1) for i in range(n_keys)] + [pa.array([v]) for v in values]
    columns.append(pa.array([float(np.sum(table.column("t").to_numpy()))]))
    return pa.Table.from_arrays(columns, [*table.column_names[1 : 1 + n_keys], "n", "u", "tie", "gap", "tie_all"])


def pair_statistics(df: DataFrame, value: str, samples: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Counts, pairwise U statistics and tie sums for every test (= key), for any number k of samples.

    ``samples`` maps a sample name to a membership condition. The result has arrays: ``n`` (rows of sample i), and in
    place ``i * k + j`` of each of the others: ``u`` = pairs where i is above j plus half the equal pairs, ``tie`` = sum of
    t^3 - t over equal values of the two samples (off the diagonal), ``gap``, which is zero exactly when both hold the same
    values. ``tie_all`` is the tie sum over all samples.

    Equal values are collapsed, the distinct values are range-partitioned, and each range makes k x k matrices.
    """
    keys = list(keys)
    k = len(samples)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counted = df.withColumn("_v", v).where("_v is not null").groupBy(*keys, "_v")
    collapsed = counted.agg(*[F.sum(F.when(c, 1.0).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(samples.values())])
    counts = F.array(*[f"c{i}" for i in range(k)]).alias("c")
    ranged = collapsed.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v")
    rows = ranged.select(F.spark_partition_id().alias("_part"), *keys, "_v", counts)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]
    arrays = [f"{c} array<double>" for c in ("s", "l", "q", "g")]
    parts = rows.mapInArrow(lambda b: _range_parts(b, k, len(keys)), ", ".join(["_part int", *fields, *arrays, "t double"]))
    result = [f"{c} array<double>" for c in ("n", "u", "tie", "gap")]
    return parts.groupBy(*keys).applyInArrow(
        lambda table: _join_ranges(table, k, len(keys)), ", ".join([*fields, *result, "tie_all double"])
    )


def sample_names(df: DataFrame, group: str) -> list[str]:
    """Sorted sample names, one entry per sample that the statistics have a column for."""
    return sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().collect())


def _members(group: str, names: Sequence[str]) -> dict[str, Column]:
    return {name: F.col(group) == F.lit(name) for name in names}


def kruskal_wallis(
    df: DataFrame, value: str, group: str, groups: Sequence[str] | None = None,
    keys: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """H statistic with tie correction, degrees of freedom, p-value and decision per test."""
    names = list(groups) if groups is not None else sample_names(df, group)
    k = len(names)
    if k < 2:
        raise ValueError(f"at least two groups are needed, found {k}")
    s = pair_statistics(df, value, _members(group, names), keys)
    zero = F.lit(0.0)
    n = F.aggregate("n", zero, lambda a, x: a + x)
    # u holds 1/2 n_i (n_i) on its diagonal: pairs of a sample with itself.
    above = [F.aggregate(F.slice("u", i * k + 1, k), zero, lambda a, x: a + x) - F.col("u")[i * k + i] for i in range(k)]
    size = [F.col("n")[i] for i in range(k)]
    rank_sum = [size[i] * (size[i] + 1) / 2 + above[i] for i in range(k)]
    # sum of n_i * (mean rank - overall mean rank)^2: the same H without the cancellation of large squares
    between = sum((size[i] * F.pow(rank_sum[i] / size[i] - (n + 1) / 2, F.lit(2.0)) for i in range(k)), zero)
    h = 12 / (n * (n + 1)) * between
    correction = 1 - F.col("tie_all") / (n * n * n - n)
    result = s.select(
        *keys, n.cast("long").alias("n"), F.try_divide(h, correction).alias("h"), F.lit(k - 1).alias("df")
    ).withColumn("p_value", chi2_tail("h", F.col("df").cast("double")))
    return result.withColumn("significant", F.col("p_value") < alpha)


def _u_p_value(n1: Column, n2: Column, u: Column, z: Column, tie: Column, same: Column, alternative: str) -> Column:
    factor = 2.0 if alternative == "two-sided" else 1.0
    small = (F.least(n1, n2) <= _SMALL_SAMPLE) & (tie == 0)
    exact = mann_whitney_small_tail(F.when(small, n1), F.when(small, n2), F.when(small, u))
    p = F.least(F.lit(1.0), F.lit(factor) * F.when(small, exact).otherwise(normal_tail(z)))
    return F.when(same, F.lit(1.0)).otherwise(p)


def mann_whitney_pairs(
    df: DataFrame, value: str, group: str, groups: Sequence[str] | None = None,
    alternative: str = "two-sided", keys: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """Mann-Whitney U for all ordered pairs of groups, from one pass over the data.

    Row columns: ``method``, ``other``, sizes, ``u1``, ``u``, ``z``, ``p_value``, ``significant``.
    Two samples with the same values are not significant, with p = 1. Untied samples with at
    most 8 values on one side get the exact p-value.
    """
    names = list(groups) if groups is not None else sample_names(df, group)
    k = len(names)
    if k < 2:
        raise ValueError(f"at least two groups are needed, found {k}")
    s = pair_statistics(df, value, _members(group, names), keys)
    cell = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1)))
    i, j = F.floor(F.col("_at") / k).cast("int"), F.col("_at") % k
    long = s.select("*", cell.alias("_at")).where(i != j).select(
        *keys, i.alias("method_order"), i.alias("_i"), j.alias("_j"), F.get("n", i).alias("n1"), F.get("n", j).alias("n2"),
        F.get("u", F.col("_at")).alias("u1"), F.get("tie", F.col("_at")).alias("tie"), (F.get("gap", F.col("_at")) == 0).alias("same"),
    )
    labels = F.array(*[F.lit(name) for name in names])
    n1, n2, u1 = F.col("n1"), F.col("n2"), F.col("u1")
    u = {"greater": u1, "less": n1 * n2 - u1, "two-sided": F.greatest(u1, n1 * n2 - u1)}[alternative]
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    named = long.select(
        *keys, "method_order", labels[F.col("_i")].alias("method"), labels[F.col("_j")].alias("other"),
        "n1", "n2", "u1", u.alias("u"), F.try_divide(u - n1 * n2 / 2 - 0.5, sd).alias("z"), "tie", "same",
    )
    p = _u_p_value(*[F.col(c) for c in ("n1", "n2", "u", "z", "tie", "same")], alternative)
    return named.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def holm_winners(pairs: DataFrame, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """A method wins when Holm's step-down procedure rejects all its pairs; with two methods the raw decision."""
    keys = list(keys)
    order = Window.partitionBy(*keys, "method").orderBy("p_value", "other")
    size = Window.partitionBy(*keys, "method")
    stepped = pairs.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(size))
    passed = stepped.groupBy(*keys, "method_order", "method").agg(
        F.max("_m").alias("partners"),
        F.bool_and(F.col("p_value") <= F.lit(alpha) / (F.col("_m") - F.col("_i") + 1)).alias("_holm"),
        F.bool_or("significant").alias("any_significant"),
    )
    holm = F.when(F.col("partners") == 1, F.col("any_significant")).otherwise(F.col("_holm"))
    return passed.select(*keys, "method_order", "method", "partners", holm.alias("holm"), "any_significant")


def first_winner(winners: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First method in method order that passes; no row when none does."""
    order = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("method_order")
    return winners.where("holm").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def wilcoxon_signed_rank(
    df: DataFrame, a: str, b: str, keys: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Two-sided signed-rank test on paired columns; zero differences are dropped.

    ``statistic`` is the smaller of both signed rank sums. At most 50 untied differences, none of them
    zero, get the exact p-value.
    """
    d = (F.col(a) - F.col(b)).cast("double")
    signed = df.select(*keys, F.nanvl(d, F.lit(None).cast("double")).alias("_d")).where("_d is not null")
    signed = signed.select(*keys, F.abs("_d").alias("_abs"), F.sign("_d").alias("_sign"))
    s = pair_statistics(signed, "_abs", {c: F.col("_sign") == v for c, v in (("pos", 1), ("neg", -1), ("zero", 0))}, keys)
    zeros = F.col("n")[2]
    # Zeros are the smallest values: they come off the ranks, and their ties off the tie sum.
    s = s.withColumn("tie_all", F.col("tie_all") - (zeros * zeros * zeros - zeros)).where(F.col("n")[0] + F.col("n")[1] > 0)
    n = F.col("n")[0] + F.col("n")[1]
    t_plus = F.col("n")[0] * (F.col("n")[0] + 1) / 2 + F.col("u")[1]
    t_minus = n * (n + 1) / 2 - t_plus
    variance = (n * (n + 1) * (2 * n + 1) - F.col("tie_all") / 2) / 24
    ranked = s.select(
        *keys, n.cast("long").alias("n"), t_plus.alias("t_plus"), F.least(t_plus, t_minus).alias("statistic"),
        F.try_divide(t_plus - n * (n + 1) / 4, F.sqrt(variance)).alias("z"), F.col("tie_all").alias("_tie"), zeros.alias("_zeros"),
    )
    small = (F.col("n") <= _SMALL_SIGNED) & (F.col("_tie") == 0) & (F.col("_zeros") == 0)
    high = F.col("n") * (F.col("n") + 1) / 2 - F.col("statistic")
    exact = signed_rank_small_tail(F.when(small, F.col("n")).otherwise(0), F.when(small, high))
    p = F.least(F.lit(1.0), 2 * F.when(small, exact).otherwise(normal_tail(F.abs("z"))))
    return ranked.withColumn("p_value", p).drop("_tie", "_zeros").withColumn("significant", F.col("p_value") < alpha)


def contingency_counts(
    df: DataFrame, outcome: str, group: str, first: str, second: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Successes and failures of two groups; any outcome other than 0 or 1 is an error."""
    x, g = F.col(outcome), F.col(group)
    in_test = df.where(g.isin(first, second))
    checked = F.when(x.isin(0, 1), x).otherwise(F.raise_error(F.lit("data contains non-binary values")).cast("int"))
    return in_test.groupBy(*keys).agg(
        F.sum(F.when(g == first, checked).otherwise(0)).cast("long").alias("s_a"),
        F.sum(F.when(g == first, 1 - checked).otherwise(0)).cast("long").alias("f_a"),
        F.sum(F.when(g == second, checked).otherwise(0)).cast("long").alias("s_b"),
        F.sum(F.when(g == second, 1 - checked).otherwise(0)).cast("long").alias("f_b"),
    )


def _verdict(df: DataFrame, alpha: float) -> DataFrame:
    rate_a = F.try_divide(F.col("s_a"), F.col("s_a") + F.col("f_a"))
    rate_b = F.try_divide(F.col("s_b"), F.col("s_b") + F.col("f_b"))
    significant = F.col("p_value") < alpha
    return df.withColumns({"significant": significant, "first_better": significant & (rate_a > rate_b)})


def chi_square_2x2(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Chi-square with Yates' correction on a 2x2 table, with the verdict columns."""
    a, b, c, d = (F.col(x).cast("double") for x in ("s_a", "f_a", "s_b", "f_b"))
    n = a + b + c + d
    shift = F.greatest(F.abs(a * d - b * c) / n - 0.5, F.lit(0.0))
    chi2 = F.try_divide(n * n * n * shift * shift, (a + b) * (c + d) * (a + c) * (b + d))
    return _verdict(counts.withColumn("chi2", chi2).withColumn("p_value", chi2_tail("chi2", F.lit(1.0))), alpha)


def fisher_2x2(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Fisher's exact test on a 2x2 table, with the verdict columns."""
    return _verdict(counts.withColumn("p_value", fisher_two_sided("s_a", "f_a", "s_b", "f_b")), alpha)
