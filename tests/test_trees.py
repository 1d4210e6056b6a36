"""Trees on binned features against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldcal.models import trees as T


def _data(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randint(0, 5)), float(rng.randint(0, 9)), rng.choice([0.0, 1.0])]
        rows.append((i, x, 3 * x[0] + (5 if x[1] > 6 else 0) + rng.random() + 1))
    return rows


@pytest.fixture(scope="module")
def ready(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(i, Vectors.dense(x), y) for i, x, y in rows], ["k", "features", "label"]).repartition(parts)

    return make


def _cost(y, w, criterion):
    y, w = np.array(y), np.array(w, float)
    if criterion == "poisson":
        m = (y * w).sum() / w.sum()
        return -(y * w).sum() * math.log(m)
    if criterion == "absolute_error":
        return (np.abs(y - np.median(y)) * w).sum()
    m = (y * w).sum() / w.sum()
    return (w * (y - m) ** 2).sum()


def plain_tree(rows, depth, criterion="squared_error", least=1):
    """Prediction of each row, by trying every cut of every feature. ``rows`` are (x, y, weight)."""
    def mean(part):
        if criterion == "absolute_error":
            return float(np.median([y for _, y, _ in part]))
        return sum(y * w for _, y, w in part) / sum(w for _, _, w in part)

    best = (1e-6, None)
    if depth:
        whole = _cost([r[1] for r in rows], [r[2] for r in rows], criterion)
        for j in range(len(rows[0][0])):
            for c in sorted({r[0][j] for r in rows})[:-1]:
                sides = [r for r in rows if r[0][j] <= c], [r for r in rows if r[0][j] > c]
                if min(map(len, sides)) >= least:
                    gain = whole - sum(_cost([r[1] for r in s], [r[2] for r in s], criterion) for s in sides)
                    if gain > best[0] * (1 + 1e-9):
                        best = gain, (j, c, sides)
    if best[1] is None:
        value = mean(rows)
        return lambda x: value
    j, c, sides = best[1]
    left, right = (plain_tree(s, depth - 1, criterion, least) for s in sides)
    return lambda x: left(x) if x[j] <= c else right(x)


@pytest.mark.parametrize("criterion,depth,least", [("squared_error", 3, 1), ("friedman_mse", 2, 30), ("poisson", 3, 5), ("squared_error", 0, 1)])
def test_tree_equals_plain_version(ready, criterion, depth, least):
    rows = _data()
    fitted = T.fit_forest(ready(rows), F.col("k").cast("string"), numTrees=1, bootstrap=False, maxDepth=depth, criterion=criterion, min_leaf=least)
    want = plain_tree([(x, y, 1) for _, x, y in rows], depth, "squared_error" if criterion == "friedman_mse" else criterion, least)
    for r in fitted.transform(ready(rows)).collect():
        assert r.prediction == pytest.approx(want(list(r.features)))


def test_absolute_error_leaves_are_medians(ready):
    rows = _data()
    fitted = T.fit_forest(ready(rows), F.col("k").cast("string"), numTrees=1, bootstrap=False, maxDepth=2, criterion="absolute_error")
    (tree,), x = fitted.trees, T._bins(np.array([r[1] for r in rows]), fitted.cuts)
    leaf, y = tree.leaves(x), np.array([r[2] for r in rows])
    assert len(set(leaf)) == 4
    for one in set(leaf):
        assert tree.value[one] == pytest.approx(np.median(y[leaf == one]))
    want = plain_tree([(r[1], r[2], 1) for r in rows], 2, "absolute_error")
    error, best = np.abs(y - tree.predict(x)).sum(), sum(abs(r[2] - want(r[1])) for r in rows)
    assert error <= 1.02 * best  # cuts are judged on target ranges


def _weight(seed, tree, key):
    digest = hashlib.md5(f"{seed}|draw|{tree // 4}|{key}".encode()).hexdigest()
    u = int(digest[8 * (tree % 4) : 8 * (tree % 4) + 8], 16) / 2**32
    return sum(u >= sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13))


def test_resampling_and_out_of_bag_votes(ready):
    rows, n_trees = _data(200), 6
    fitted = T.fit_forest(ready(rows), F.col("k").cast("string"), seed=9, numTrees=n_trees, maxDepth=2)
    weights = {(t, i): _weight(9, t, i) for t in range(n_trees) for i, _, _ in rows}
    plain = [plain_tree([(x, y, weights[t, i]) for i, x, y in rows if weights[t, i]], 2) for t in range(n_trees)]
    for r in fitted.transform(ready(rows)).collect():
        assert r.prediction == pytest.approx(np.mean([p(list(r.features)) for p in plain]))
    votes = [(y, [p(x) for t, p in enumerate(plain) if not weights[t, i]]) for i, x, y in rows]
    y, p = (np.array(v) for v in zip(*[(y, np.mean(v)) for y, v in votes if v]))
    assert fitted.oob_r2 == pytest.approx(1 - np.mean((y - p) ** 2) / np.var(y))
    assert 0.3 < np.mean([w == 0 for w in weights.values()]) < 0.44
    again = T.fit_forest(ready(rows, 1), F.col("k").cast("string"), seed=9, numTrees=n_trees, maxDepth=2)
    for a, b in zip(fitted.trees, again.trees):
        assert (a.feature, a.bin, a.left) == (b.feature, b.bin, b.left) and a.value == pytest.approx(b.value)


def test_levels_in_several_passes_and_features_drawn(ready, monkeypatch):
    rows = _data()
    wide = T.fit_forest(ready(rows), F.col("k").cast("string"), seed=3, numTrees=4, maxDepth=4, featureSubsetStrategy="sqrt", min_leaf=0.01)
    monkeypatch.setattr(T, "_HISTOGRAM_BYTES", 1)
    slow = T.fit_forest(ready(rows), F.col("k").cast("string"), seed=3, numTrees=4, maxDepth=4, featureSubsetStrategy="sqrt", min_leaf=0.01)
    for a, b in zip(wide.trees, slow.trees):
        assert (a.feature, a.bin, a.left) == (b.feature, b.bin, b.left) and a.value == pytest.approx(b.value)
    assert len({tuple(t.feature) for t in wide.trees}) > 1
    loose = T.fit_forest(ready(rows), F.col("k").cast("string"), numTrees=1, bootstrap=False, maxDepth=3, splitter="random")
    assert len(loose.trees[0].left) > 1
    back = T.TreeEnsemble.from_json(wide.to_json())
    assert [r.prediction for r in back.transform(ready(rows)).orderBy("k").collect()] == [r.prediction for r in wide.transform(ready(rows)).orderBy("k").collect()]


@pytest.mark.parametrize("loss", T.LOSSES)
def test_boosting_equals_plain_version(ready, loss, monkeypatch):
    monkeypatch.setattr(T, "_REWRITE_EVERY", 2)
    rows, step, alpha = _data(150), 0.5, 0.8
    fitted = T.fit_boosting(ready(rows), F.col("k").cast("string"), loss=loss, maxIter=3, maxDepth=2, stepSize=step, alpha=alpha)
    y, x = np.array([r[2] for r in rows]), [r[1] for r in rows]
    middle = {"absolute_error": 0.5, "huber": 0.5, "quantile": alpha}.get(loss)
    f = np.full(len(y), y.mean() if middle is None else np.quantile(y, middle))
    for _ in range(3):
        r = y - f
        delta = np.quantile(np.abs(r), alpha)
        goal = {"squared_error": r, "absolute_error": np.sign(r), "huber": np.clip(r, -delta, delta), "quantile": np.where(r > 0, alpha, alpha - 1)}[loss]
        tree = plain_tree([(a, g, 1) for a, g in zip(x, goal)], 2)
        leaf = np.array([tree(a) for a in x])
        for one in set(leaf):
            part = r[leaf == one]
            if loss == "squared_error":
                value = part.mean()
            else:
                value = np.quantile(part, middle)
                if loss == "huber":
                    value += np.clip(part - value, -delta, delta).mean()
            f[leaf == one] += step * value
    got = {r.k: r.prediction for r in fitted.transform(ready(rows)).collect()}
    # leaves with one gradient by chance are one leaf in this plain version
    assert [got[i] for i, _, _ in rows] == pytest.approx(f, abs=0.02 if loss in ("absolute_error", "quantile") else 1e-9)


def test_boosting_stops_on_the_rows_held_back(ready):
    rows = _data()
    held = F.col("k") % 4 == 0
    fitted = T.fit_boosting(ready(rows), F.col("k").cast("string"), maxIter=60, maxDepth=2, stepSize=0.5, validate=held, n_iter_no_change=2)
    longer = T.fit_boosting(ready(rows), F.col("k").cast("string"), maxIter=60, maxDepth=2, stepSize=0.5, validate=held, n_iter_no_change=2, tol=-1.0)
    assert 3 <= len(fitted.trees) < 60 and len(longer.trees) == 60
    train = [r for r in rows if r[0] % 4]
    same = T.fit_boosting(ready(train), F.col("k").cast("string"), maxIter=len(fitted.trees), maxDepth=2, stepSize=0.5)
    assert same.start == pytest.approx(fitted.start)


def test_parameters(ready):
    rows = ready(_data(30))
    for bad in ({"criterion": "gini"}, {"splitter": "worst"}, {"featureSubsetStrategy": "half"}, {"max_bins": 1}):
        with pytest.raises(ValueError):
            T.fit_forest(rows, F.col("k").cast("string"), numTrees=1, **bad)
    with pytest.raises(ValueError):
        T.fit_boosting(rows, F.col("k").cast("string"), loss="deviance")
    with pytest.raises(ValueError):
        T.fit_forest(rows.limit(0), F.col("k").cast("string"))
