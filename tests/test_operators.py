"""Operators against brute force on small fixtures, and their behaviour on skew and partitioning."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcal.functions.tails import _chi2_tail, _fisher_two_sided, _small_signed_tail, _small_u_tail
from fieldcal.operators.eda import correlation_matrix, density_by_category, histogram
from fieldcal.operators.hull import convex_hulls
from fieldcal.operators.lines import lines_only_in_first, parameter_grid, same_lines
from fieldcal.operators.metrics import linear_scaling, regression_metrics
from fieldcal.operators.ordering import (
    chunk_rows,
    contiguous_folds,
    exact_split,
    head_rows,
    with_positions,
    zip_by_position,
)
from fieldcal.operators.prep import apply_scaling, augment_rare, feature_pipeline, fit_scaling, unscale_linear
from fieldcal.operators.quantiles import exact_quantiles
from fieldcal.operators.ranktests import (
    chi_square_2x2,
    contingency_counts,
    fisher_2x2,
    first_winner,
    holm_winners,
    kruskal_wallis,
    mann_whitney_pairs,
    wilcoxon_signed_rank,
)
from fieldcal.session import join_lookup


def table(spark, rows, schema, parts=6):
    return spark.createDataFrame(rows, schema).repartition(parts)


def mid_ranks(values):
    ordered = sorted(values)
    return [(ordered.index(v) + 1 + ordered.index(v) + ordered.count(v)) / 2 for v in values]


@pytest.mark.parametrize("small_group,accuracy", [(100_000, 50_000), (50, 200)])
def test_exact_quantiles_equal_numpy_also_with_narrow_brackets(spark, small_group, accuracy):
    rng = random.Random(1)
    groups = {
        "hot": [round(rng.expovariate(0.01), 2) for _ in range(4000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(900)],
        "tiny": [1.0, 2.0],
        "one": [5.0],
        "same": [7.0] * 300,
    }
    df = table(spark, [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), (None, 3.0)], "g string, v double")
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = exact_quantiles(df, "v", probs, ["g"], small_group=small_group, accuracy=accuracy).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        assert r.n == len(groups[r.g])
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(groups[r.g], p * 100), abs=1e-9), (r.g, name)
    whole = exact_quantiles(df, "v", {"m": 0.5}, small_group=small_group, accuracy=accuracy).first()
    assert whole.m == pytest.approx(np.median([v for vs in groups.values() for v in vs] + [3.0]))


def test_positions_are_a_total_order_over_partitions(spark):
    values = random.Random(2).sample(range(10_000), 3000)
    got = with_positions(table(spark, [(v,) for v in values], "v long"), ["v"]).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.position)] == sorted(values)
    assert sorted(r.position for r in got) == list(range(3000))
    left, right = table(spark, [(3,), (1,), (2,)], "a long"), table(spark, [("c",), ("a",), ("b",)], "b string")
    assert sorted(r[:] for r in zip_by_position(left, right, ["a"], ["b"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        zip_by_position(left, right.limit(2), ["a"], ["b"])


@pytest.mark.parametrize("n,share", [(10, 0.3), (101, 0.3), (7, 0.5), (1, 0.3)])
def test_split_and_fold_sizes(spark, n, share):
    df = table(spark, [(i,) for i in range(n)], "k long")
    split = exact_split(df, ["k"], share, 5)
    assert split.where("split = 'test'").count() == math.ceil(n * share)
    again = exact_split(df.repartition(1), ["k"], share, 5)
    assert split.exceptAll(again).count() == 0  # the same rows for any partitioning
    if n >= 4:
        sizes = [r["count"] for r in contiguous_folds(df, ["k"], 4, 5).groupBy("fold").count().orderBy("fold").collect()]
        assert sizes == [n // 4 + (1 if i < n % 4 else 0) for i in range(4)]
        assert head_rows(df, ["k"], 3, 5).count() == 3
    assert head_rows(df, ["k"], 0, 5).count() == n
    with pytest.raises(ValueError):
        head_rows(df, ["k"], -1, 5)


def test_chunks_as_planned(spark):
    df = spark.createDataFrame([(f"l{i}",) for i in range(9)], "line string")
    sizes = [r["count"] for r in chunk_rows(df, ["line"], 6, "plan").groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [2, 2, 2, 2, 1]  # 9 lines in 6 files: batches of 2, no empty chunk
    assert {r.run_id for r in chunk_rows(df, ["line"], 1, "plan").collect()} == {"plan"}


def test_grid_and_lines(spark):
    grid = parameter_grid(spark, {"model": ["a", "b"], "cv": 4, "seed": [1, 2, 3]})
    assert grid.count() == 6 and grid.select("cv").distinct().count() == 1
    a = spark.createDataFrame([("x",), ("x",), ("y",), (" ",), ("",)], "value string")
    b = spark.createDataFrame([("y",), ("y",), ("",)], "value string")
    assert [r.value for r in lines_only_in_first(a, b).collect()] == ["x", "x"]
    assert same_lines(a, b).first().same is False
    c = spark.createDataFrame([("y",), ("x",), ("x",), ("  ",)], "value string")
    assert same_lines(a, c).first().same is True


def test_metrics_against_formulas(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(20, 5), rng.gauss(20, 5), rng.gauss(10, 3)) for _ in range(500)]
    y, p, x = (np.array(c) for c in zip(*rows))
    r = regression_metrics(table(spark, rows, "y double, p double, x double"), "y", "p", raw="x").first()
    assert r.mse == pytest.approx(np.mean((y - p) ** 2)) and r.rmse == pytest.approx(math.sqrt(r.mse))
    assert r.mae == pytest.approx(np.mean(np.abs(y - p))) and r.mae_sum_back == pytest.approx(r.mae)
    assert r.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert r.r2_sum_back == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y + x - (y + x).mean()) ** 2))
    line = linear_scaling(table(spark, rows, "y double, p double, x double"), "y", "p").first()
    slope = np.cov(y, p)[0, 1] / (np.var(p) + 1e-12)
    assert (line.slope, line.intercept) == (pytest.approx(slope), pytest.approx(y.mean() - slope * p.mean()))
    constant = table(spark, [(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert regression_metrics(constant, "y", "p").first().r2 == 1.0


def test_scaling_and_unscaling(spark):
    df = table(spark, [(float(i), 3.0) for i in range(11)], "a double, b double")
    for strategy, center, scale in [
        ("standard", 5.0, math.sqrt(10.0)), ("minmax", 0.0, 10.0), ("robust", 5.0, 5.0), ("none", 0.0, 1.0)
    ]:
        s = fit_scaling(df, ["a", "b"], strategy)
        assert s["a"] == (pytest.approx(center), pytest.approx(scale))
        if strategy != "none":
            assert {r.b for r in apply_scaling(df, s).collect()} == {0.0}
    raw, intercept = unscale_linear({"a": 2.0}, 1.0, {"a": (5.0, 4.0)})
    assert raw["a"] * 9.0 + intercept == pytest.approx(2.0 * (9.0 - 5.0) / 4.0 + 1.0)
    with pytest.raises(ValueError):
        fit_scaling(df, ["a"], "other")


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "c string, x double")
    model = feature_pipeline(["c"], ["x"]).fit(train)
    got = model.transform(spark.createDataFrame([("a", 5.0), ("z", 6.0)], "c string, x double")).collect()
    assert [list(r.features.toArray()) for r in got] == [[1.0, 0.0, 5.0], [0.0, 0.0, 6.0]]


def test_augmentation(spark):
    df = table(spark, [(i, float(i), float(i)) for i in range(100)], "k long, x double, y double")
    made = augment_rare(df, "y", ["x"], F.col("k").cast("string"), 0.9, 5, 0.04, 0.0, seed=1)
    rare = sum(1 for i in range(100) if i > np.percentile(range(100), 90))
    assert made.count() == 100 + 5 * rare
    noise = [r.x - r.k for r in made.where("copy > 0").collect()]
    assert len(set(noise)) == len(noise) and abs(np.std(noise) - 0.04) < 0.02
    assert augment_rare(df, "y", ["x"], F.col("k").cast("string"), 0.9, 5, 0.04, 9.0, seed=1).where("y < 0").count() == 0
    same = augment_rare(df.repartition(1), "y", ["x"], F.col("k").cast("string"), 0.9, 5, 0.04, 0.0, seed=1)
    assert made.exceptAll(same).count() == 0


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_rank_tests_against_brute_force(spark):
    rng = random.Random(4)
    groups = {g: [round(rng.gauss(m, 2), 1) for _ in range(n)] for g, m, n in [("a", 10, 60), ("b", 10.5, 80), ("c", 12, 50)]}
    df = table(spark, [(g, v) for g, vs in groups.items() for v in vs], "g string, v double", 9)
    pooled = [v for vs in groups.values() for v in vs]
    ranks = dict(zip(pooled, mid_ranks(pooled)))
    n = len(pooled)
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    h = 12 / (n * (n + 1)) * sum(sum(ranks[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    kw = kruskal_wallis(df, "v", "g").first()
    assert kw.h == pytest.approx(h / (1 - ties / (n**3 - n))) and kw.df == 2 and kw.significant
    assert kw.p_value == pytest.approx(math.exp(-kw.h / 2))  # closed form for two degrees of freedom
    pairs = {(r.method, r.other): r for r in mann_whitney_pairs(df, "v", "g", alternative="less").collect()}
    for (a, va), (b, vb) in itertools.permutations(groups.items(), 2):
        r = pairs[a, b]
        assert r.u1 == brute_u(va, vb)
        t = sum((va + vb).count(v) ** 3 - (va + vb).count(v) for v in set(va + vb))
        m = len(va) + len(vb)
        sd = math.sqrt(len(va) * len(vb) / 12 * ((m + 1) - t / (m * (m - 1))))
        z = (len(va) * len(vb) - r.u1 - len(va) * len(vb) / 2 - 0.5) / sd
        assert r.p_value == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
        assert r.u1 + pairs[b, a].u1 == len(va) * len(vb)
    winners = holm_winners(mann_whitney_pairs(df, "v", "g", alternative="less"))
    expected = {}
    for a in groups:
        p = sorted(pairs[a, b].p_value for b in groups if b != a)
        expected[a] = all(x <= 0.05 / (len(p) - i) for i, x in enumerate(p))
    assert {r.method: r.holm for r in winners.collect()} == expected
    assert first_winner(winners).count() == (1 if any(expected.values()) else 0)


def test_mann_whitney_special_cases(spark):
    same = table(spark, [(g, float(v)) for g in "ab" for v in range(20)], "g string, v double")
    assert {(r.p_value, r.significant) for r in mann_whitney_pairs(same, "v", "g").collect()} == {(1.0, False)}
    # published exact table: samples 1..3 against 4..6 have one-sided p = 1/20
    small = table(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    p = {r.method: r.p_value for r in mann_whitney_pairs(small, "v", "g", alternative="less").collect()}
    assert p["a"] == pytest.approx(0.05) and p["b"] == pytest.approx(1.0)
    two = holm_winners(mann_whitney_pairs(same, "v", "g"))
    assert {r.holm for r in two.collect()} == {False}
    with pytest.raises(ValueError):
        mann_whitney_pairs(same.where("g = 'a'"), "v", "g")


def test_wilcoxon_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(round(rng.gauss(10, 3), 1), round(rng.gauss(10.6, 3), 1)) for _ in range(120)] + [(1.0, 1.0)]
    d = [round(a - b, 10) for a, b in rows if a != b]
    exact = [a - b for a, b in rows if a != b]
    ranks = mid_ranks([abs(x) for x in exact])
    r = wilcoxon_signed_rank(table(spark, rows, "a double, b double"), "a", "b").first()
    assert r.n == len(d) and r.t_plus == sum(k for k, x in zip(ranks, exact) if x > 0)
    assert 0 < r.p_value < 1
    # textbook: six positive differences 1..6 have two-sided exact p = 2 / 2^6
    six = table(spark, [(float(i), 0.0) for i in range(1, 7)], "a double, b double")
    assert wilcoxon_signed_rank(six, "a", "b").first().p_value == pytest.approx(2 / 64)


def test_tails_against_known_values():
    assert _chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert _chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert _chi2_tail(200.0, 3) == pytest.approx(4.2e-43, rel=0.1)
    assert _fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert _fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496)
    assert _fisher_two_sided(10**9, 10**9, 10**9, 10**9) == pytest.approx(1.0, abs=1e-3)
    for n1, n2 in [(3, 4), (5, 2)]:
        arrangements = list(itertools.combinations(range(1, n1 + n2 + 1), n1))
        for u in range(n1 * n2 + 1):
            tail = sum(sum(c) - n1 * (n1 + 1) / 2 >= u for c in arrangements) / len(arrangements)
            assert _small_u_tail(n1, n2, u) == pytest.approx(tail)
    assert _small_signed_tail(3, 6) == pytest.approx(1 / 8)


def test_contingency(spark):
    rows = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 15 + [("b", 0)] * 25
    counts = contingency_counts(table(spark, rows, "g string, x int"), "x", "g", "a", "b")
    r = chi_square_2x2(counts).first()
    expected = 80 * (abs(30 * 25 - 10 * 15) - 40) ** 2 / (40 * 40 * 45 * 35)
    assert r.chi2 == pytest.approx(expected) and r.significant and r.first_better
    assert fisher_2x2(counts).first().significant
    bad = contingency_counts(table(spark, [("a", 2)], "g string, x int"), "x", "g", "a", "b")
    with pytest.raises(Exception, match="non-binary"):
        bad.collect()


def test_hull_equals_brute_force(spark):
    rng = random.Random(6)
    pts = [("z", rng.randint(0, 30) * 1.0, rng.randint(0, 30) * 1.0) for _ in range(700)]
    pts += [("few", 0.0, 0.0), ("few", 1.0, 1.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0)]
    got = convex_hulls(table(spark, pts, "z string, x double, y double", 12), "z", "x", "y", spread=3).collect()
    by_zone = {z: {(r.x, r.y) for r in got if r.z == z} for z in ("z", "few", "line")}
    unique = sorted({(x, y) for z, x, y in pts if z == "z"})

    def corner(p):
        """A corner has a line through it with every other point strictly on one side."""
        angles = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in unique if q != p)
        gaps = [b - a for a, b in zip(angles, angles[1:] + [angles[0] + 2 * math.pi])]
        return max(gaps) > math.pi + 1e-12

    assert by_zone["z"] == {p for p in unique if corner(p)}
    assert by_zone["few"] == set() and by_zone["line"] == {(0.0, 0.0), (2.0, 2.0)}


def test_eda_small(spark):
    rows = [(float(v), g) for g, vs in {"a": [1, 2, 2, 9], "b": [4, 5, 7, 30]}.items() for v in vs]
    df = table(spark, rows, "v double, g string")
    bins = histogram(df, ["v"], 30).collect()
    assert len(bins) == 30 and sum(r.n for r in bins) == 8 and max(bins, key=lambda r: r.bin).n == 1
    density = density_by_category(df, "g", "v", grid_size=50).where("g = 'a'").collect()
    vs = np.array([1, 2, 2, 9.0])
    h = np.std(vs, ddof=1) * 4 ** -0.2
    for r in density:
        assert r.density == pytest.approx(np.mean(np.exp(-((r.x - vs) / h) ** 2 / 2)) / (h * math.sqrt(2 * math.pi)))
    assert min(r.x for r in density) == 0.0
    corr = {(r.column_a, r.column_b): r.r for r in correlation_matrix(df.withColumn("w", -F.col("v"))).collect()}
    assert corr["v", "w"] == pytest.approx(-1.0) and corr["v", "v"] == 1.0


def test_lookup_join_is_the_same_below_and_above_the_bound(spark):
    big = table(spark, [(i % 5, i) for i in range(50)], "k int, v int")
    lookup = spark.createDataFrame([(i, i * 10) for i in range(5)], "k int, w int")
    small, large = join_lookup(big, lookup, ["k"]), join_lookup(big, lookup, ["k"], max_rows=3)
    assert small.exceptAll(large).count() == 0 and small.count() == large.count() == 50
