"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are dealt into shards of bounded size and queries into bounded blocks; each (shard, block) pair is one
group, so the query set is searched against all rows in blocks. A shard's index holds, for each component, its
vectors in order of their value, cut into segments of one quantised level. A query turns each segment into an
*impact*, the most that its component can add to a score. Segments are processed by descending impact: every
vector in them gets the exact contribution of that component, counted from the least contribution possible, so
what a vector has so far is a lower bound of its score. The sum over the components of what their unread segments
can add at most bounds what any vector may still gain.

Processing stops only on proof: once every vector outside the running best ``k`` has a bound below the k-th
best so far, except for few possible members. These (all that the bound leaves open, ties included) are rescored
exactly from their vectors. If no proof comes, everything has been read and the sums are exact.

The best ``k`` of all shards are then ranked per query.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part, nor does a row
with a null id; a shorter vector counts as ending in zeros; ties go to the smaller id; a query has fewer rows
if there are fewer candidates; of rows that repeat a query's id one (the smallest vector) is the query, and none of
them is its candidate; other repeated rows are candidates of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import stored

#: Vectors in a shard and queries in a block.
SHARD_ROWS = 8_192
BLOCK_ROWS = 1_024
#: Quantised levels of a component, and impact steps after which the proof is tried.
LEVELS = 64
STEPS = 12
#: Possible members that are rescored instead of reading on.
RESCORE = 512


class ImpactIndex:
    """Posting segments of one shard: per component the rows by descending value and the level borders."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, self.dims = self.vectors.shape
        self.rows = np.argsort(-self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors, self.rows.T, axis=0).T.copy()
        self.cuts = []
        for d in range(self.dims):
            v = self.values[d]
            step = max(1, -(-int(v[0] - v[-1] + 1) // levels))
            level = (v - v[-1]) // step
            self.cuts.append(np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [n]]))

    def search(self, query: np.ndarray, own: int, k: int, rescore: int = RESCORE) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows whose id is not ``own``."""
        n = len(self.ids)
        allowed = self.ids != own
        wanted = min(k, int(allowed.sum()))
        if wanted == 0:
            return self.ids[:0], np.zeros(0, np.int64)
        dims = np.flatnonzero(query[: self.dims])
        parts = []  # per component: segment borders in reading order, values, rows
        least = gain = 0
        for d in dims:
            q = int(query[d])
            cut = self.cuts[d]
            if q > 0:
                low, rows, values = int(self.values[d, -1]) * q, self.rows[d], self.values[d]
            else:  # the smallest value adds most: read backwards
                low, rows, values = int(self.values[d, 0]) * q, self.rows[d, ::-1], self.values[d, ::-1]
                cut = n - cut[::-1]
            impact = values[cut[:-1]] * q - low
            parts.append((q, low, rows, values, cut, impact))
            least, gain = least + low, gain + int(impact[0])
        sums = np.full(n, least, np.int64)
        read = [0] * len(parts)
        top = max((int(p[5][0]) for p in parts), default=0)
        for step in range(STEPS):
            floor = top * (STEPS - 1 - step) // STEPS if step < STEPS - 1 else -1
            gain = 0
            for j, (q, low, rows, values, cut, impact) in enumerate(parts):
                to = int(np.searchsorted(-impact, -floor, side="left"))  # segments of impact > floor
                if to > read[j]:
                    a, b = cut[read[j]], cut[to]
                    sums[rows[a:b]] += values[a:b] * q - low
                    read[j] = to
                gain += int(impact[read[j]]) if read[j] < len(impact) else 0
            reach = sums[allowed]
            bar = np.partition(reach, len(reach) - wanted)[len(reach) - wanted]
            open_ = allowed & (sums + gain >= bar)
            if gain == 0 or int(open_.sum()) <= max(rescore, 2 * wanted):
                break
        rows = np.flatnonzero(open_)
        scores = self.vectors[rows] @ query[: self.dims]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of every component; null where the vector may not take part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(fit, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search_group(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    parts = []
    if len(queries) and len(rows):
        dims = max(max(map(len, queries["v"])), max(map(len, rows["v"])))
        index = ImpactIndex(rows["id"].to_numpy(np.int64), _matrix(rows["v"], dims))
        for own, query in zip(queries["id"].to_numpy(np.int64), _matrix(queries["v"], dims)):
            ids, scores = index.search(query, own, k)
            parts.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(
    rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row that ``is_query`` selects."""
    vectors = stored(
        rows.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("asks"))
        .filter("id is not null and v is not null"),
        "vectors",
    )
    queries = vectors.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    counts = vectors.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("asks"), F.col("id"))).alias("q")).first()
    shards, blocks = max(1, math.ceil(counts["n"] / shard_rows)), max(1, math.ceil(counts["q"] / block_rows))
    # Each vector meets each block of queries once, each query each shard once.
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    held = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    found = (
        asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block"))
        .applyInPandas(lambda q, r: _search_group(q, r, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
