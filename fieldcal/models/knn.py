"""Exact k-nearest-neighbour regression on a tree of pivots.

About the square root of the training rows serve as pivots; the fourth root of them as the first level of a tree, under which
each pivot stands with its nearest. A row goes down the tree to its cell, and the rows are written with their cells. Each
cell keeps its number of rows and its reach, the distance from the pivot to its furthest row, and so does each first-level group.

A search has two rounds. First every query looks into its own cell, which bounds the distance of its k-th neighbour. Then it
visits only the cells that can hold something closer: by the triangle inequality those whose distance, less their reach, is
within the bound; groups are ruled out before their cells are looked at. Cells and their queries are cut into blocks of bounded
size, each block gives its k best, and the best of all are taken by rank in a window that each task limits to k rows before the
shuffle. Nothing is approximated, and there is one way for every size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import scratch_scope, stored

#: Pivots at most, so that the tree that all tasks share has a bound; cells of more rows are searched in more blocks.
MOST_PIVOTS = 1 << 14
#: Distances computed at once in a task.
_CHUNK = 2_000_000
_FOUND = "x array<double>, d double, y double"
#: Distances are rounded; a bound is widened by this share.
_SLACK = 1e-9


def _points(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, computed from differences so that equal points are at exactly 0."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d
    return np.sqrt(out)


def _nearest(d: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances and their labels; equal distances are ordered by label."""
    k = min(k, d.shape[1])
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(d, at, axis=1).max(axis=1)
    for i in np.flatnonzero((d <= edge[:, None]).sum(axis=1) > k):  # a tie at the edge
        tied = np.flatnonzero(d[i] <= edge[i])
        at[i] = tied[np.lexsort((y[tied], d[i, tied]))][:k]
    near_d, near_y = np.take_along_axis(d, at, axis=1), y[at]
    order = np.lexsort((near_y, near_d), axis=1)
    return np.take_along_axis(near_d, order, axis=1), np.take_along_axis(near_y, order, axis=1)


class PivotTree:
    """Pivots of the cells, the first-level group of each, and what the cells and groups hold."""

    def __init__(self, pivots: np.ndarray, groups: int):
        self.pivots = pivots
        self.top = pivots[:groups]
        self.group = np.concatenate([np.arange(groups), self._nearest_top(pivots[groups:])])
        self.members = [np.flatnonzero(self.group == g) for g in range(groups)]

    def _nearest_top(self, x: np.ndarray) -> np.ndarray:
        step = max(1, _CHUNK // len(self.top))
        parts = [_distances(x[i : i + step], self.top).argmin(axis=1) for i in range(0, len(x), step)]
        return np.concatenate([np.zeros(0, int), *parts])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, its distance from the cell's pivot, and from the group's."""
        group = self._nearest_top(x)
        cell, radius = np.zeros(len(x), int), np.zeros(len(x))
        for g in np.unique(group):
            rows, members = np.flatnonzero(group == g), self.members[g]
            step = max(1, _CHUNK // len(members))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                d = _distances(x[some], self.pivots[members])
                at = d.argmin(axis=1)
                cell[some], radius[some] = members[at], d[np.arange(len(some)), at]
        far = np.sqrt(((x - self.top[group]) ** 2).sum(axis=1))
        return cell, radius, far

    def hold(self, cells: np.ndarray, n: np.ndarray, reach: np.ndarray, group_reach: np.ndarray) -> None:
        """Rows and reach of the cells that have rows."""
        self.n, self.reach = np.zeros(len(self.pivots), int), np.zeros(len(self.pivots))
        self.n[cells], self.reach[cells] = n, reach
        self.group_n = np.bincount(self.group, weights=self.n, minlength=len(self.top)).astype(int)
        self.group_reach = np.zeros(len(self.top))
        np.maximum.at(self.group_reach, self.group[cells], group_reach)

    def sure(self, q: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has k rows, from the groups alone."""
        far = _distances(q, self.top) + self.group_reach
        far[:, self.group_n == 0] = np.inf
        order = np.argsort(far, axis=1)
        enough = np.argmax(np.cumsum(self.group_n[order], axis=1) >= k, axis=1)
        rows = np.arange(len(q))
        return far[rows, order[rows, enough]]

    def reachable(self, q: np.ndarray, bound: np.ndarray, own: np.ndarray) -> list[list[int]]:
        """Cells other than its own that can hold a row within the bound of a query."""
        limit = bound * (1 + _SLACK) + _SLACK
        found: list[list[int]] = [[] for _ in q]
        near = (_distances(q, self.top) - self.group_reach <= limit[:, None]) & (self.group_n > 0)
        for g in np.flatnonzero(near.any(axis=0)):
            rows = np.flatnonzero(near[:, g])
            members = self.members[g][self.n[self.members[g]] > 0]
            step = max(1, _CHUNK // max(1, len(members)))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                hit = _distances(q[some], self.pivots[members]) - self.reach[members] <= limit[some, None]
                hit &= members[None, :] != own[some, None]
                for r, c in zip(*np.nonzero(hit)):
                    found[some[r]].append(int(members[c]))
        return found


@dataclass
class Neighbours:
    rows: DataFrame  # cell, x (array of double), y: the training rows, of equal ones at most k
    cells: DataFrame  # cell, pivot, first (it is of the first level), n, reach, group_reach
    k: int
    weights: str
    block_rows: int

    def tree(self) -> PivotTree:
        """The tree, from its table of at most ``MOST_PIVOTS`` rows."""
        rows = self.cells.orderBy("cell").collect()
        tree = PivotTree(np.array([r["pivot"] for r in rows], dtype=float), sum(r["first"] for r in rows))
        held = [r for r in rows if r["n"]]
        tree.hold(*(np.array([r[c] for r in held]) for c in ("cell", "n", "reach", "group_reach")))
        return tree

    def transform(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        spark, k = df.sparkSession, self.k
        tree = self.tree()
        if tree.n.sum() < k:
            raise ValueError(f"{k} neighbours need at least as many training rows")
        shared = spark.sparkContext.broadcast(tree)
        with scratch_scope(spark):

            @F.pandas_udf("cell int, sure double")
            def entry(x: pd.Series) -> pd.DataFrame:
                points = _points(x) if len(x) else np.zeros((0, shared.value.pivots.shape[1]))
                return pd.DataFrame({"cell": shared.value.place(points)[0].astype("int32"), "sure": shared.value.sure(points, k)})

            @F.pandas_udf("array<int>")
            def reachable(x: pd.Series, bound: pd.Series, own: pd.Series) -> pd.Series:
                if not len(x):
                    return pd.Series([], dtype="object")
                return pd.Series(shared.value.reachable(_points(x), bound.to_numpy(), own.to_numpy()))

            # Equal points have the same answer.
            points = df.select(vector_to_array(F.col(features)).alias("x")).where("x is not null").distinct()
            queries = stored(points.select("x", entry("x").alias("e")).select("x", "e.cell", "e.sure"), "queries")
            own = stored(self._search(queries.select("x", "cell"), int(tree.n.sum())), "own")
            kth = own.groupBy("x").agg(F.when(F.count("*") >= k, F.max("d")).alias("kth"))
            bounded = queries.join(kth, "x", "left").withColumn("bound", F.least("sure", F.coalesce("kth", "sure")))
            visits = stored(bounded.select("x", F.explode(reachable("x", "bound", "cell")).alias("cell")), "visits")
            found = own.unionByName(self._search(visits, int(tree.n.sum())))
            place = Window.partitionBy("x").orderBy("d", "y")
            best = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
            answers = stored(best.groupBy("x").agg(self._vote().alias("vote")), "answers", keep=True)
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), vector_to_array(F.col(features)).alias("x"))
        told = rows.join(answers, "x", "left")
        return told.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("vote").alias(output))

    def _search(self, visits: DataFrame, rows: int) -> DataFrame:
        """x, d, y: the k best rows of each visited block of a cell (x, cell).

        Cells of one block share a task with others; a larger one is cut into blocks of rows and of queries.
        """
        k = self.k
        tasks = max(visits.sparkSession.sparkContext.defaultParallelism, -(-rows // self.block_rows))
        load = visits.groupBy("cell").count()
        size = self.cells.where("n > 0").select("cell", F.ceil(F.col("n") / self.block_rows).cast("int").alias("parts"))
        plan = size.join(load, "cell").select("cell", "parts", F.ceil(F.col("count") / self.block_rows).cast("int").alias("query_parts"))
        whole = (F.col("parts") == 1) & (F.col("query_parts") == 1)
        plan = plan.withColumn("task", F.when(whole, -1 - F.pmod(F.col("cell"), F.lit(tasks))).otherwise(F.col("cell")))
        plan = F.broadcast(plan)  # a row for each cell: MOST_PIVOTS at most
        train = (
            self.rows.join(plan, "cell")
            .withColumn("part", F.pmod(F.xxhash64("x", "y"), "parts").cast("int"))
            .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
            .select(*[F.col(c).alias(c) for c in ("task", "part", "query_part", "cell", "x", "y")])
        )
        queries = (
            visits.join(plan, "cell")
            .withColumn("query_part", F.pmod(F.xxhash64("x"), "query_parts").cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(*[F.col(c).alias(c) for c in ("task", "part", "query_part", "cell", "x")])
        )

        def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(q) and len(t):
                q, t = q.sort_values("cell"), t.sort_values("cell")
                points, x, y, inside = _points(q["x"]), _points(t["x"]), t["y"].to_numpy(), t["cell"].to_numpy()
                cells, first = np.unique(q["cell"].to_numpy(), return_index=True)
                for cell, a, b in zip(cells, first, [*first[1:], len(q)]):
                    lo, hi = np.searchsorted(inside, [cell, cell + 1])
                    step = max(1, _CHUNK // max(1, hi - lo))
                    for i in range(a, b if hi > lo else a, step):
                        d, near = _nearest(_distances(points[i : min(b, i + step)], x[lo:hi]), y[lo:hi], k)
                        asked = q["x"].iloc[i : i + len(d)].repeat(d.shape[1])
                        found.append(pd.DataFrame({"x": asked.to_numpy(), "d": d.ravel(), "y": near.ravel()}))
            if not found:
                return pd.DataFrame({"x": pd.Series([], dtype="object"), "d": pd.Series([], dtype=float), "y": pd.Series([], dtype=float)})
            return pd.concat(found, ignore_index=True)

        by = ["task", "part", "query_part"]
        return queries.groupBy(*by).cogroup(train.groupBy(*by)).applyInPandas(search, _FOUND)

    def _vote(self) -> Column:
        """Mean label, plain or by inverse distance; neighbours at distance 0 outvote all others."""
        if self.weights == "uniform":
            return F.avg("y")
        exact = F.avg(F.when(F.col("d") == 0, F.col("y")))
        return F.coalesce(exact, F.sum(F.try_divide("y", "d")) / F.sum(F.try_divide(F.lit(1.0), "d")))


def fit_knn(
    df: DataFrame, features: str = "features", label: str = "label", k: int = 5, weights: str = "uniform",
    block_rows: int = 20_000, most_pivots: int = MOST_PIVOTS,
) -> Neighbours:
    if weights not in ("uniform", "distance"):
        raise ValueError("choose the weights 'uniform' or 'distance'")
    spark = df.sparkSession
    points = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    with scratch_scope(spark):
        # Of equal rows at most k can be among the k nearest.
        held = points.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("times"))
        train = stored(held.withColumn("times", F.least(F.lit(k), F.col("times")).cast("int")), "train")
        n = train.agg(F.sum("times")).first()[0] or 0
        if n < k:
            raise ValueError(f"{k} neighbours need at least as many training rows")
        pivots = min(most_pivots, math.isqrt(n - 1) + 1)
        drawn = train.orderBy(F.xxhash64("x", "y"), "x", "y").select("x").limit(pivots).collect()
        points_of = list(dict.fromkeys(tuple(r["x"]) for r in drawn))  # in order of the draw, each once
        first = math.isqrt(len(points_of) - 1) + 1
        tree = PivotTree(np.array(points_of, dtype=float), first)
        shared = spark.sparkContext.broadcast(tree)

        @F.pandas_udf("cell int, radius double, far double")
        def place(x: pd.Series) -> pd.DataFrame:
            points = _points(x) if len(x) else np.zeros((0, shared.value.pivots.shape[1]))
            cell, radius, far = shared.value.place(points)
            return pd.DataFrame({"cell": cell.astype("int32"), "radius": radius, "far": far})

        placed = stored(train.withColumn("p", place("x")).select("p.*", "x", "y", "times"), "placed")
        rows = placed.select("cell", "x", "y", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")
        rows = stored(rows, "rows", keep=True)
        stats = placed.groupBy("cell").agg(F.sum("times").alias("n"), F.max("radius").alias("reach"), F.max("far").alias("group_reach"))
        every = spark.createDataFrame([(i, list(p), i < first) for i, p in enumerate(points_of)], "cell int, pivot array<double>, first boolean")
        cells = every.join(stats, "cell", "left").fillna({"n": 0, "reach": 0.0, "group_reach": 0.0})
        cells = stored(cells, "cells", keep=True)
    return Neighbours(rows, cells, k, weights, block_rows)
