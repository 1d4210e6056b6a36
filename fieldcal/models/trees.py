"""Regression trees on binned features: bagging, forests, single trees by any criterion, and gradient boosting.

Features are cut into bins at sketched quantiles once, and the bins are written, a byte each. All trees of a forest
grow together: for each level one pass over the table adds up histograms of every open node, feature and bin, Spark sums them
by node, the best cut of a node is found where its histogram was summed, and the driver gets one row for each open node. Levels with
very many open nodes take several passes, so that the histograms of a task have a bound.

Resampling is Poisson(1): the weight of a row in a tree comes from a hash of seed, tree and row key, so that any engine can
redraw it, whatever the partitions. A row is out of bag where its weight is 0; its votes are added up in its own row.

Boosting fits each tree to the gradient of its loss and then gives every leaf the best step of that loss: a mean, or an exact
quantile of the leaf's residuals, which no task has to hold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.operators.metrics import regression_metrics
from fieldcal.operators.quantiles import exact_quantiles
from fieldcal.session import scratch_scope, stored

CRITERIA = ("squared_error", "friedman_mse", "poisson", "absolute_error")
LOSSES = ("squared_error", "absolute_error", "huber", "quantile")
MAX_BINS = 64
#: Target ranges by which the absolute error of a cut is judged; leaf medians are exact.
_TARGET_BINS = 32
#: Bytes of the histograms of one task.
_HISTOGRAM_BYTES = 1 << 26
#: Rounds of boosting after which the predictions so far are written down.
_REWRITE_EVERY = 20
#: Least relative gain of a cut, above the rounding of sums.
_LEAST_GAIN = 1e-9
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


@dataclass
class Tree:
    """Nodes as lists: an inner node sends bins up to ``bin`` of ``feature`` to ``left``; ``left`` is 0 in a leaf."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, cut, len(self.left), len(self.left) + 1
        for column, new in ((self.feature, (0, 0)), (self.bin, (0, 0)), (self.left, (0, 0)), (self.right, (0, 0)), (self.value, values)):
            column.extend(new)
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.asarray(c) for c in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        while True:
            inner = left[node] > 0
            if not inner.any():
                return node
            step = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
            node = np.where(inner, step, node)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(bins)]


def _bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as a matrix."""
    if not width or not len(column):
        return np.zeros((len(column), width), np.uint8)
    _, where, data = column.cast(pa.binary()).buffers()
    first = int(np.frombuffer(where, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[first : first + len(column) * width].reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    where = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, where, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


@dataclass
class Goal:
    """What a tree is fitted to, from the target and the prediction so far."""

    kind: str = "target"
    alpha: float = 0.9
    delta: float = 1.0

    def __call__(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The target, the residual, or the negative gradient of a loss."""
        if self.kind == "target":
            return y
        if self.kind in ("residual", "squared_error"):
            return y - f
        if self.kind == "absolute_error":
            return np.sign(y - f)
        if self.kind == "huber":
            return np.clip(y - f, -self.delta, self.delta)
        return np.where(y > f, self.alpha, self.alpha - 1.0)


@dataclass
class TreeEnsemble:
    """A fitted model: the mean of its trees, or a start plus the sum of their steps."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    start: float | None = None  # of boosting
    oob_r2: float | None = None

    def transform(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.trees, self.start))

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            cuts, trees, start = shared.value
            if not len(x):
                return pd.Series([], dtype=float)
            bins = _bins(np.array(x.tolist(), dtype=float).reshape(len(x), len(cuts)), cuts)
            total = sum((t.predict(bins) for t in trees), np.zeros(len(x)))
            return pd.Series(total / max(1, len(trees)) if start is None else start + total)

        return df.withColumn(output, predict(vector_to_array(F.col(features))))

    def to_json(self) -> str:
        trees = [vars(t) for t in self.trees]
        return json.dumps({"cuts": [c.tolist() for c in self.cuts], "trees": trees, "start": self.start, "oob_r2": self.oob_r2})

    @classmethod
    def from_json(cls, text: str) -> TreeEnsemble:
        d = json.loads(text)
        return cls([np.array(c, dtype=float) for c in d["cuts"]], [Tree(**t) for t in d["trees"]], d["start"], d["oob_r2"])


# ---------------------------------------------------------------- the binned table


def _cuts(df: DataFrame, max_bins: int) -> list[np.ndarray]:
    """Per feature the middles between neighbouring quantiles."""
    probs = [i / max_bins for i in range(max_bins + 1)]
    long = df.select(F.posexplode("x").alias("at", "v"))
    rows = long.groupBy("at").agg(F.percentile_approx("v", probs, 100 * max_bins).alias("q")).collect()  # one row for each feature
    found = [np.unique(r["q"]) for r in sorted(rows, key=lambda r: r["at"])]
    return [(q[1:] + q[:-1]) / 2 for q in found]


def draw_digests(key: Column, seed: int, trees: int) -> Column:
    """Hex digits of the draws: eight for each tree, four trees to a hash of seed, number and row key."""
    hashes = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.lit(str(i)), key)) for i in range(-(-trees // 4))]
    return F.concat(*hashes) if hashes else F.lit("")


def binned_table(
    ready: DataFrame, key: Column, seed: int, trees: int = 0, max_bins: int = MAX_BINS, validate: Column | None = None
) -> tuple[DataFrame, list[np.ndarray]]:
    """Table of y, bins, weights of a row in each tree, held back or not, prediction so far; and the cuts."""
    if not 2 <= max_bins <= 256:
        raise ValueError("a feature has 2 to 256 bins")
    rows = ready.select(
        vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double").alias("y"),
        draw_digests(key, seed, trees).alias("digits"), (F.lit(False) if validate is None else F.coalesce(validate, F.lit(False))).alias("held"),
    ).where("x is not null and y is not null")
    cuts = _cuts(rows, max_bins)
    if not cuts:
        raise ValueError("no rows to fit")
    shared = ready.sparkSession.sparkContext.broadcast(cuts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            bins = _bins(_matrix(batch.column(0), len(shared.value)), shared.value)
            draws = np.frombuffer(bytes.fromhex("".join(batch.column(2).to_pylist())), ">u4").reshape(n, -(-trees // 4) * 4)[:, :trees]
            weights = np.searchsorted(_POISSON, draws / 2.0**32, side="right").astype(np.uint8)
            arrays = [
                batch.column(1), _binary(bins), _binary(weights), batch.column(3), pa.array(np.zeros(n)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["y", "bins", "weights", "held", "f"])

    return stored(rows.mapInArrow(write, "y double, bins binary, weights binary, held boolean, f double"), "binned"), cuts


# ---------------------------------------------------------------- growing


@dataclass
class _Pass:
    """What the tasks of one pass need."""

    trees: list[Tree]
    slots: list[np.ndarray]  # per tree: the slot of each node, -1 if it is not open in this pass
    nodes: list[tuple[int, int]]  # tree and node of each slot
    features: int
    bins: int
    resampled: bool
    target: Goal
    done: list[Tree]  # trees whose steps are not in the table's predictions yet
    criterion: str
    edges: np.ndarray  # of the target's ranges
    least: int
    most_features: int
    seed: int
    random_cuts: bool

    @property
    def ranges(self) -> int:
        return _TARGET_BINS if self.criterion == "absolute_error" else 1

    def shape(self) -> tuple[int, ...]:
        return self.features, self.bins, self.ranges, 3


def so_far(part: Sequence[Tree], bins: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Predictions with the steps of some trees."""
    return sum((t.predict(bins) for t in part), f.copy())


def _histograms(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """slot, histogram: for each feature, bin and target range the rows, their weight and their weighted target."""
    p: _Pass = shared.value
    n_slots, (features, bins, ranges, _) = len(p.nodes), p.shape()
    total = np.zeros((features, 3, n_slots * bins * ranges))
    for batch in batches:
        if not len(batch):
            continue
        x = _bytes(batch.column(1), features)
        y, f = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        weights = _bytes(batch.column(2), len(p.trees)) if p.resampled else None
        goal = p.target(y, so_far(p.done, x, f))
        spot = np.searchsorted(p.edges, goal, side="left") if ranges > 1 else np.zeros(len(y), int)
        free = ~batch.column(3).to_numpy(zero_copy_only=False)
        for t, tree in enumerate(p.trees):
            slot = p.slots[t][tree.leaves(x)]
            live = np.flatnonzero((slot >= 0) & free & (weights[:, t] > 0 if p.resampled else True))
            if not len(live):
                continue
            w = weights[live, t].astype(float) if p.resampled else np.ones(len(live))
            for j in range(features):
                at = (slot[live] * bins + x[live, j]) * ranges + spot[live]
                for s, value in enumerate((None, w, w * goal[live])):
                    total[j, s] += np.bincount(at, value, minlength=total.shape[2])
    total = total.reshape(features, 3, n_slots, bins, ranges).transpose(2, 0, 3, 4, 1)
    for slot in np.flatnonzero(total[..., 0].any(axis=(1, 2, 3))):
        data = np.ascontiguousarray(total[slot]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([data], pa.binary())], ["slot", "data"])


def _cost(h: np.ndarray, criterion: str) -> np.ndarray:
    """Cost of nodes with histograms h (…, ranges, 3), up to what all cuts of a node share."""
    w, s = h[..., 1].sum(-1), h[..., 2].sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if criterion == "poisson":
            return np.where(s > 0, -s * np.log(s / w), np.where(w > 0, np.inf, 0.0))
        if criterion != "absolute_error":
            return np.where(w > 0, -s * s / w, 0.0)
        mean = h[..., 2] / h[..., 1]
        seen = np.cumsum(h[..., 1], axis=-1)
        middle = np.argmax(seen >= w[..., None] / 2, axis=-1)[..., None]
        median = np.take_along_axis(mean, middle, axis=-1)
        away = np.where(h[..., 1] > 0, h[..., 1] * np.abs(mean - median), 0.0)
        return np.where(w > 0, away.sum(-1), 0.0)


def best_cut(h: np.ndarray, p: _Pass, slot: int) -> tuple[float, int, int, np.ndarray]:
    """Gain, feature, bin, and histogram to the left of the best cut; a gain of 0 if there is none.

    Features are looked at in an order drawn for the node; beyond ``most_features`` only until one has a cut.
    """
    left = np.cumsum(h, axis=1)[:, :-1]
    right = h.sum(axis=1)[:, None] - left
    before = _cost(h.sum(axis=1), p.criterion)  # the same for every feature
    gain = before[:, None] - _cost(left, p.criterion) - _cost(right, p.criterion)
    allowed = (left[..., 0].sum(-1) >= p.least) & (right[..., 0].sum(-1) >= p.least)
    gain = np.where(allowed & np.isfinite(gain), gain, 0.0)
    gain[gain <= _LEAST_GAIN * np.abs(before[:, None])] = 0.0
    draw = np.random.default_rng([p.seed % 2**32, *p.nodes[slot]])
    if p.random_cuts:  # one drawn cut for each feature
        for j in range(len(gain)):
            some = np.flatnonzero(gain[j])
            keep = draw.choice(some) if len(some) else 0
            gain[j] = np.where(np.arange(gain.shape[1]) == keep, gain[j], 0.0)
    order = draw.permutation(p.features) if p.most_features < p.features else np.arange(p.features)
    chosen, found = -1, 0.0
    for place, j in enumerate(order):
        if place >= p.most_features and chosen >= 0:
            break
        top = gain[j].max(initial=0.0)
        if top > found * (1 + _LEAST_GAIN) or (top > 0 and chosen >= 0 and top >= found * (1 - _LEAST_GAIN) and j < chosen):
            chosen, found = int(j), float(top)
    if chosen < 0:
        return 0.0, 0, 0, h[0, 0] * 0
    cut = int(np.argmax(gain[chosen]))
    return found, chosen, cut, left[chosen, cut]


def _grown(pairs: DataFrame, shared) -> DataFrame:
    def choose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total = shared.value, 0.0
        for batch in batches:
            for data in batch.column("data"):
                total = total + np.frombuffer(data.as_buffer(), float).reshape(p.shape())
        slot = key[0].as_py()
        gain, feature, cut, left = best_cut(total, p, slot)
        whole, left = total[0].sum(axis=(0, 1)), left.sum(axis=0)
        row = [slot, gain, feature, cut, *whole, *left]
        names = ["slot", "gain", "feature", "bin", "n", "w", "s", "n_left", "w_left", "s_left"]
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    schema = "slot int, gain double, feature int, bin int, n double, w double, s double, n_left double, w_left double, s_left double"
    return pairs.groupBy("slot").applyInArrow(choose, schema)


def grow(
    table: DataFrame, cuts: Sequence[np.ndarray], trees: int, max_depth: int, least: int = 1, least_split: int = 2, most_features: int | None = None,
    criterion: str = "squared_error", resampled: bool = False, seed: int = 0, random_cuts: bool = False,
    target: Goal = Goal(), done: Sequence[Tree] = (), edges: np.ndarray | None = None,
) -> list[Tree]:
    """Trees grown together, level by level; the value of a node is the mean of its targets."""
    context = table.sparkSession.sparkContext
    grown, features, bins = [Tree() for _ in range(trees)], len(cuts), max(len(c) for c in cuts) + 1
    ranges = _TARGET_BINS if criterion == "absolute_error" else 1
    width = max(1, _HISTOGRAM_BYTES // (features * bins * ranges * 3 * 8))
    open_nodes = [(t, 0) for t in range(trees)]
    for depth in range(max_depth + 1):
        after = []
        for a in range(0, len(open_nodes), width):
            nodes = open_nodes[a : a + width]
            slots = [np.full(len(t.left), -1) for t in grown]
            for slot, (t, node) in enumerate(nodes):
                slots[t][node] = slot
            plan = _Pass(
                grown, slots, nodes, features, bins, resampled, target, list(done), criterion,
                np.zeros(0) if edges is None else edges, least, min(most_features or features, features), seed, random_cuts,
            )
            shared = context.broadcast(plan)
            pairs = table.mapInArrow(lambda b: _histograms(b, shared), "slot int, data binary")
            rows = _grown(pairs, shared).collect()  # one row for each open node
            shared.unpersist()
            for r in sorted(rows, key=lambda r: r["slot"]):
                t, node = nodes[r["slot"]]
                grown[t].value[node] = r["s"] / r["w"]
                if depth == max_depth or not r["gain"] or r["n"] < least_split:
                    continue
                right = (r["n"] - r["n_left"], r["w"] - r["w_left"], r["s"] - r["s_left"])
                values = (r["s_left"] / r["w_left"], right[2] / right[1])
                children = grown[t].split(node, r["feature"], r["bin"], values)
                sizes = r["n_left"], right[0]
                after += [(t, c) for c, n in zip(children, sizes) if n >= max(2 * least, least_split, 2)]
        open_nodes = after
        if not open_nodes or depth + 1 >= max_depth:
            break
    return grown


def _feature_count(strategy: str, features: int) -> int:
    counts = {"all": features, "sqrt": max(1, int(math.sqrt(features))), "log2": max(1, int(math.log2(features)))}
    if strategy not in counts:
        raise ValueError(f"choose one of {sorted(counts)} features")
    return counts[strategy]


def _least(min_leaf: float, n: int) -> int:
    """A leaf minimum of 1 or more is a row count, below 1 a share of the rows."""
    return int(min_leaf) if min_leaf >= 1 else max(1, math.ceil(min_leaf * n))


def _edges(table: DataFrame) -> np.ndarray:
    probs = [i / _TARGET_BINS for i in range(1, _TARGET_BINS)]
    return np.unique(table.agg(F.percentile_approx("y", probs, 10_000)).first()[0])


# ---------------------------------------------------------------- forests


def _width(table: DataFrame) -> int:
    """Features of a binned table."""
    row = table.select(F.octet_length("bins").alias("n")).first()
    return row["n"] if row else 0


def _per_leaf(table: DataFrame, trees: Sequence[Tree], resampled: bool, goal: Goal = Goal(), done: Sequence[Tree] = ()) -> DataFrame:
    """tree, leaf, v: what each tree was fitted to in each row, as often as the row was drawn."""
    width = _width(table)
    shared = table.sparkSession.sparkContext.broadcast((list(trees), goal, list(done), width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, of, before, width = shared.value
        for batch in batches:
            if not len(batch):
                continue
            y, f = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            x = _bytes(batch.column(1), width)
            free = ~batch.column(3).to_numpy(zero_copy_only=False)
            v = of(y, so_far(before, x, f))
            for t, tree in enumerate(grown):
                times = _bytes(batch.column(2), len(grown))[:, t].astype(int) if resampled else np.ones(len(y), int)
                at = np.repeat(np.arange(len(y)), times * free)
                leaf = tree.leaves(x)[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(leaf, pa.int32()), pa.array(v[at])], ["tree", "leaf", "v"])

    return table.mapInArrow(rows, "tree int, leaf int, v double")


def _set_leaves(trees: Sequence[Tree], values: DataFrame, column: str, scale: float = 1.0) -> None:
    for r in values.select("tree", "leaf", column).collect():  # one row for each leaf
        trees[r["tree"]].value[r["leaf"]] = scale * r[column]


def out_of_bag(table: DataFrame, trees: Sequence[Tree]) -> DataFrame:
    """y, prediction, votes: the mean of the trees that did not draw the row; null where every tree did."""
    shared = table.sparkSession.sparkContext.broadcast((list(trees), _width(table)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, width = shared.value
        for batch in batches:
            if not len(batch):
                continue
            n, x = len(batch), _bytes(batch.column(1), width)
            away = _bytes(batch.column(2), len(grown)) == 0
            total = sum((np.where(away[:, t], tree.predict(x), 0.0) for t, tree in enumerate(grown)), np.zeros(n))
            votes = away.sum(axis=1)
            mean = pa.array(total / np.maximum(votes, 1), mask=votes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), mean, pa.array(votes.astype(np.int32))], ["y", "prediction", "votes"])

    return table.mapInArrow(rows, "y double, prediction double, votes int")


def fit_forest(
    ready: DataFrame, key: Column, seed: int = 0, numTrees: int = 10, maxDepth: int = 5, min_leaf: float = 1, min_split: int = 2,
    featureSubsetStrategy: str = "all", criterion: str = "squared_error", bootstrap: bool = True, oob_score: bool = True,
    splitter: str = "best", max_bins: int = MAX_BINS,
) -> TreeEnsemble:
    """Mean of trees on resampled rows; one tree without resampling is a decision tree. ``key`` tells all rows apart."""
    if criterion not in CRITERIA or splitter not in ("best", "random"):
        raise ValueError(f"choose a criterion of {CRITERIA} and the splitter 'best' or 'random'")
    with scratch_scope(ready.sparkSession):
        table, cuts = binned_table(ready, key, seed, numTrees if bootstrap else 0, max_bins)
        absolute = criterion == "absolute_error"
        trees = grow(
            table, cuts, numTrees, maxDepth, _least(min_leaf, table.count() if min_leaf < 1 else 0), min_split,
            _feature_count(featureSubsetStrategy, len(cuts)), criterion, bootstrap, seed, splitter == "random", edges=_edges(table) if absolute else None,
        )
        if absolute:
            medians = exact_quantiles(_per_leaf(table, trees, bootstrap), "v", {"median": 0.5}, ["tree", "leaf"])
            _set_leaves(trees, medians, "median")
        score = None
        if bootstrap and oob_score:
            score = regression_metrics(out_of_bag(table, trees), "y", "prediction").first()["r2"]
    return TreeEnsemble(cuts, trees, None, score)


# ---------------------------------------------------------------- boosting


def loss_column(loss: str, alpha: float, delta: float) -> Column:
    """Loss of a row of ``r``, the target less the prediction."""
    r, size = F.col("r"), F.abs("r")
    return {
        "squared_error": r * r / 2, "absolute_error": size,
        "huber": F.when(size <= delta, r * r / 2).otherwise(delta * (size - delta / 2)),
        "quantile": F.when(r > 0, alpha * r).otherwise((alpha - 1) * r),
    }[loss]


def _predicted(table: DataFrame, trees: Sequence[Tree]) -> DataFrame:
    """The table with the steps of ``trees`` in its predictions."""
    shared = table.sparkSession.sparkContext.broadcast((list(trees), _width(table)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, width = shared.value
        for batch in batches:
            f = so_far(grown, _bytes(batch.column(1), width), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(f)], batch.schema.names)

    return table.mapInArrow(rows, table.schema)


def fit_boosting(
    ready: DataFrame, key: Column, seed: int = 0, loss: str = "squared_error", stepSize: float = 0.1, maxIter: int = 20, maxDepth: int = 3,
    min_leaf: float = 1, min_split: int = 2, featureSubsetStrategy: str = "all", validate: Column | None = None, n_iter_no_change: int | None = None,
    tol: float = 1e-4, alpha: float = 0.9, max_bins: int = MAX_BINS,
) -> TreeEnsemble:
    """Gradient boosting. With ``validate``, rows where it is true are held back, and boosting stops when their loss has not fallen
    by ``tol`` in ``n_iter_no_change`` rounds."""
    if loss not in LOSSES:
        raise ValueError(f"choose a loss of {LOSSES}")
    with scratch_scope(ready.sparkSession):
        table, cuts = binned_table(ready, key, seed, 0, max_bins, validate)
        free = table.where("not held")
        middle = {"absolute_error": 0.5, "huber": 0.5, "quantile": alpha}.get(loss)
        if middle is None:
            start = free.agg(F.avg("y")).first()[0]
        else:
            start = exact_quantiles(free, "y", {"q": middle}).first()["q"]
        table = table.withColumn("f", F.lit(float(start)))
        least = _least(min_leaf, free.count() if min_leaf < 1 else 0)
        most = _feature_count(featureSubsetStrategy, len(cuts))
        trees: list[Tree] = []
        fresh: list[Tree] = []  # since the predictions were last written
        history = [math.inf] * (n_iter_no_change or 0)
        for i in range(maxIter):
            delta = 1.0
            if loss == "huber":
                left = _per_leaf(table, [Tree()], False, Goal("residual"), fresh)
                delta = exact_quantiles(left.select(F.abs("v").alias("v")), "v", {"q": alpha}).first()["q"]
            (tree,) = grow(
                table, cuts, 1, maxDepth, least, min_split, most, seed=seed + i, target=Goal(loss, alpha, delta), done=fresh
            )
            if loss == "squared_error":
                tree.value = [stepSize * v for v in tree.value]
            else:
                rests = _per_leaf(table, [tree], False, Goal("residual"), fresh)
                steps = exact_quantiles(rests, "v", {"q": middle}, ["tree", "leaf"])
                _set_leaves([tree], steps, "q", 1.0)
                if loss == "huber":  # the median, and the mean of what is left, cut at delta
                    at = F.element_at(F.array(*[F.lit(float(v)) for v in tree.value]), F.col("leaf") + 1)
                    more = F.greatest(F.lit(-delta), F.least(F.lit(delta), F.col("v") - at))
                    added = rests.groupBy("tree", "leaf").agg((F.first(at) + F.avg(more)).alias("q"))
                    _set_leaves([tree], added, "q", 1.0)
                tree.value = [stepSize * v for v in tree.value]
            trees.append(tree)
            fresh.append(tree)
            if validate is not None and n_iter_no_change:
                held = _predicted(table.where("held"), fresh).select((F.col("y") - F.col("f")).alias("r"))
                now = held.agg(F.avg(loss_column(loss, alpha, delta))).first()[0]
                if now is not None:
                    if not any(now + tol < h for h in history):
                        break
                    history[i % len(history)] = now
            if len(fresh) == _REWRITE_EVERY:
                table, fresh = stored(_predicted(table, fresh), "boosted"), []
    return TreeEnsemble(cuts, trees, float(start))
