"""Exact quantiles that never gather a group in one task.

The built-in exact percentile keeps every distinct value of a group in one aggregation
buffer. Here a mergeable sketch first brackets each wanted quantile; a second pass counts,
with map-side combine, the few values inside the brackets and only *how many* rows lie
between them. Brackets are cut into many value ranges: their counts, a bounded number per group, say which
range holds an order statistic, and only the values of such ranges are ranked. Two scans, no shuffle
of the values outside the brackets, and the result is exact (linear interpolation).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import join_lookup

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


#: Value ranges in a bracket.
_RANGES = 1024


def _bracket(lows: Sequence[Column], highs: Sequence[Column], v: Column) -> Column:
    """Place a value: itself when inside a bracket, else the lower edge of the next bracket; ``slot`` numbers gaps and ranges."""
    placed = None
    for i, (low, high) in enumerate(zip(lows, highs)):
        first = i * (_RANGES + 2)
        share = F.nanvl(F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)), F.lit(0.0))
        slot = F.lit(first + 1) + F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * _RANGES).cast("int")
        gap = F.struct(low.alias("at"), F.lit(False).alias("inside"), F.lit(first).alias("slot"))
        own = F.struct(v.alias("at"), F.lit(True).alias("inside"), slot.alias("slot"))
        placed = F.when(v < low, gap) if placed is None else placed.when(v < low, gap)
        placed = placed.when(v <= high, own)
    return placed


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    small_group: int = 100_000,
    accuracy: int = 50_000,
    also: Mapping[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """One row per group: the keys, the non-null count ``n`` and one column per named quantile.

    Rows with a NULL or NaN value or a NULL key do not count. Groups of at most ``small_group``
    rows are bracketed whole; larger ones by a sketch whose rank error is at most
    ``n / accuracy``, with a margin of five times that error on both sides. A quantile
    outside its bracket would raise, it is never approximated. ``also`` names further
    aggregates of the value, such as ``F.avg``, that ride along in the first scan.
    """
    keys, also = list(keys), dict(also or {})
    names = sorted(probs, key=lambda name: probs[name])
    margin = max(5.0 / accuracy, 5.0 / small_group)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, v.alias("_v"))
    for key in ["_v", *keys]:
        rows = rows.where(F.col(key).isNotNull())

    edges = [max(0.0, probs[n] - margin) for n in names] + [min(1.0, probs[n] + margin) for n in names]
    stats = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
        *[f("_v").alias(name) for name, f in also.items()],
    )
    small = F.col("_n") <= small_group
    carried = ["_n", *also]
    bounds = stats.select(
        *keys,
        *carried,
        *[
            F.when(small | F.lit(edges[i] <= 0.0), F.col("_min")).otherwise(F.col("_edges")[i]).alias(f"_lo{i}")
            for i in range(len(names))
        ],
        *[
            F.when(small | F.lit(edges[len(names) + i] >= 1.0), F.col("_max"))
            .otherwise(F.col("_edges")[len(names) + i])
            .alias(f"_hi{i}")
            for i in range(len(names))
        ],
    )
    if keys:
        placed = join_lookup(rows, bounds, keys)
    else:
        row = bounds.first()
        placed = rows.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in bounds.schema.fields})

    lows = [F.col(f"_lo{i}") for i in range(len(names))]
    highs = [F.col(f"_hi{i}") for i in range(len(names))]
    # The join below asks for slots that are not null; asked for here too, both of its sides share one scan and shuffle.
    counted = (
        placed.select(*keys, *carried, _bracket(lows, highs, F.col("_v")).alias("_p"))
        .where(F.col("_p").isNotNull())
        .select(*keys, *carried, F.col("_p.at").alias("_at"), F.col("_p.inside").alias("_inside"), F.col("_p.slot").alias("_slot"))
        .where(F.col("_slot").isNotNull())
        .groupBy(*keys, *carried, "_at", "_inside", "_slot")
        .agg(F.count("*").alias("_c"))
    )
    # A bounded number of slots per group: where does each begin, and does it hold a wanted rank?
    slots = counted.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_size"), F.max("_n").alias("_all"))
    end = F.sum("_size").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slot"))
    slots = slots.withColumn("_base", end - F.col("_size"))
    wanted = F.lit(False)
    for name in names:
        for rank in (F.floor, F.ceil):
            at = rank((F.col("_all") - 1) * F.lit(float(probs[name])))
            wanted = wanted | ((F.col("_base") <= at) & (at < F.col("_base") + F.col("_size")))
    slots = slots.where(wanted).select(*keys, "_slot", "_base")
    order = Window.partitionBy(*keys, "_slot").orderBy("_at", "_inside")
    ranked = counted.join(slots, [*keys, "_slot"]).withColumn("_end", F.col("_base") + F.sum("_c").over(order))

    def order_statistic(rank: Column) -> Column:
        covers = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
        return F.max(F.when(covers & F.col("_inside"), F.col("_at")))

    picked = []
    for i, name in enumerate(names):
        h = (F.col("_n") - 1) * F.lit(float(probs[name]))
        picked += [order_statistic(F.floor(h)).alias(f"_a{i}"), order_statistic(F.ceil(h)).alias(f"_b{i}")]
    chosen = ranked.groupBy(*keys, *carried).agg(*picked)

    def interpolate(i: int, name: str) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(probs[name]))
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        missed = F.raise_error(F.lit(f"quantile {name} lies outside its bracket")).cast("double")
        return F.when(a.isNull() | b.isNull(), missed).otherwise(a + (b - a) * (h - F.floor(h)))

    index = {name: i for i, name in enumerate(names)}
    return chosen.select(
        *keys, F.col("_n").alias("n"), *also, *[interpolate(index[name], name).alias(name) for name in probs]
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], **options) -> DataFrame:
    """Quantiles of many numeric columns at once: one row per column name."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return exact_quantiles(long, "value", probs, ["column"], **options)


def bounded_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Quantiles of groups whose size has a fixed bound (seeds of a run, models of an ensemble).

    Uses the built-in exact percentile: one shuffle, one small buffer per group.
    """
    v = F.col(value)
    return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(float(p))).alias(name) for name, p in probs.items()])
