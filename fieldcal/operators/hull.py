"""Bounding boxes, shared scales and convex hulls per zone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.geo import mercator_x, mercator_y


def bounding_boxes(df: DataFrame, zone: str, lon: str, lat: str, pad: float = 0.05) -> DataFrame:
    """Padded box per zone in Web Mercator metres and its height/width ratio; a zero side counts as 1."""
    x, y = mercator_x(F.col(lon)), mercator_y(F.col(lat))
    box = df.groupBy(zone).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    dx = F.when(F.col("_x1") > F.col("_x0"), F.col("_x1") - F.col("_x0")).otherwise(1.0)
    dy = F.when(F.col("_y1") > F.col("_y0"), F.col("_y1") - F.col("_y0")).otherwise(1.0)
    return box.select(
        zone,
        (F.col("_x0") - dx * pad).alias("x_min"), (F.col("_x1") + dx * pad).alias("x_max"),
        (F.col("_y0") - dy * pad).alias("y_min"), (F.col("_y1") + dy * pad).alias("y_max"),
        (dy / dx).alias("ratio"),
    )


def shared_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: minimum and maximum over all columns and zones."""
    cols = [F.col(c) for c in columns]
    return df.agg(F.min(F.least(*cols)).alias("v_min"), F.max(F.greatest(*cols)).alias("v_max"))


def _outside_octagon(points: np.ndarray) -> np.ndarray:
    """Drop points clearly inside the polygon of the eight extreme points: none of them can be a corner."""
    x, y = points[:, 0], points[:, 1]
    scores = np.stack([x, x + y, y, y - x, -x, -x - y, -y, x - y])  # directions in counter-clockwise order
    ring = points[scores.argmax(axis=1)]
    after = np.roll(ring, -1, axis=0)
    slack = 1e-9 * (np.ptp(x) + np.ptp(y) + 1e-300) ** 2
    inside = np.ones(len(points), dtype=bool)
    for (ax, ay), (bx, by) in zip(ring, after):
        if (ax, ay) != (bx, by):
            inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) > slack
    return points[~inside]


def _hull(points: np.ndarray) -> np.ndarray:
    """Hull corners, counter-clockwise from the leftmost point (monotone chain)."""
    if len(points) > 16:
        points = _outside_octagon(points)
    points = np.unique(points, axis=0)
    if len(points) <= 2:
        return points

    def half(ordered):
        chain: list = []
        for p in ordered:
            while len(chain) >= 2 and (
                (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])
            ) <= 0:
                chain.pop()
            chain.append(p)
        return chain

    return np.array(half(points)[:-1] + half(points[::-1])[:-1])


def convex_hulls(df: DataFrame, zone: str, x: str, y: str, spread: int = 64) -> DataFrame:
    """Hull corners per zone in drawing order; zones need more than two points.

    Each task keeps only the hull of what it has read, so a zone of any size shrinks before
    the shuffle; partial hulls merge in ``spread`` groups per zone and then once per zone.
    """
    points = df.select(F.col(zone).alias("zone"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fields = "zone string, x double, y double, n long"

    def corners_of(name, xy: np.ndarray, n: int) -> pd.DataFrame:
        corners = _hull(xy)
        counted = np.zeros(len(corners), dtype="int64")
        counted[0] = n  # the row count travels with the first corner
        return pd.DataFrame({"zone": name, "x": corners[:, 0], "y": corners[:, 1], "n": counted})

    def reduce_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            for name, part in batch.groupby("zone"):
                xy = part[["x", "y"]].to_numpy()
                seen, n = kept.get(name, (xy[:0], 0))
                kept[name] = (_hull(np.vstack([seen, xy])), n + len(xy))
        for name, (xy, n) in kept.items():
            yield corners_of(name, xy, n)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return corners_of(group["zone"].iloc[0], group[["x", "y"]].to_numpy(), int(group["n"].sum()))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        merged = merge(group)
        merged["corner"] = np.arange(len(merged))
        return merged[["zone", "corner", "x", "y"]] if merged["n"].sum() > 2 else merged[["zone", "corner", "x", "y"]][:0]

    partial = points.dropna().mapInPandas(reduce_partition, fields)
    salted = partial.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(spread)))
    halfway = salted.groupBy("zone", "_salt").applyInPandas(merge, fields)
    hulls = halfway.groupBy("zone").applyInPandas(finish, "zone string, corner int, x double, y double")
    return hulls.withColumnRenamed("zone", zone)
