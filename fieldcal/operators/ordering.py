"""Positions, exact splits and folds without a global one-task window."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import stored

# Hash keys are spread over 16**4 prefixes, so the per-prefix counts are a bounded driver fetch.
_PREFIX_DIGITS = 4
# Ranges of time are looked up in a table of so many equal spans; a row costs one look.
_SPANS = 1 << 13


def hash_key(seed: int | str, *key: Column) -> Column:
    """Seeded shuffle order: the md5 of the seed and the row key. ``key`` must identify the row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def _numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> tuple[DataFrame, int]:
    """Rows with their place in a total order, and the number of rows.

    Rows are range-partitioned and sorted; the place inside a partition comes from the
    built-in row counter, and only one offset per partition is joined back. The sorted
    rows are written because counts and rows must see the same partition bounds.
    """
    ranged = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranged"
    )
    part = F.shiftright(F.col("_id"), 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).collect()
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):  # one entry per partition
        offsets.append((row["_part"], total))
        total += row["_rows"]
    if not offsets:
        return ranged.drop("_id").withColumn(name, F.lit(0).cast("long")), 0
    lookup = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(lookup), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_id", "_part", "_offset")
    )
    return placed, total


def with_positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2… in a total order, without a window over the whole table."""
    return _numbered(df, order, name)[0]


def zip_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Put two tables side by side by position, each in its own total order; unequal lengths are an error."""
    a, n_left = _numbered(left, left_order, "_position")
    b, n_right = _numbered(right, right_order, "_position")
    if n_left != n_right:
        raise ValueError(f"mismatch in the number of rows of the two tables: {n_left} and {n_right}")
    return a.join(b, "_position").drop("_position")


def sorted_by_time(
    df: DataFrame, order: Sequence[str], times: DataFrame, share: float = 0.01, least: int = 100
) -> DataFrame:
    """``df`` sorted by ``order``, whose first column is a zone-less time, cut into ranges of about as many rows of ``times``.

    ``orderBy`` runs the whole plan of ``df`` once more to find its cuts, and compares each row with many of them. Here a share of
    ``times`` (one time column, cheaper than ``df``) gives the cuts; every row of ``df`` is sorted whatever they are. With fewer than
    ``least`` times a range, or two cuts so near that a range could not be split further, ``orderBy`` does it all.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    second = F.unix_timestamp(F.col(times.columns[0]))  # of a zone-less time: no zone comes in
    found = times.sample(share, seed=0).select(second.alias("s")).agg(
        F.count("s").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"),
        F.percentile_approx("s", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts"),
    ).first()
    if n < 2 or found["n"] < least * n:
        return df.orderBy(*order)
    lo, width = found["lo"], (found["hi"] - found["lo"] + 1) / _SPANS
    at = [int((cut - lo) / width) for cut in found["cuts"]]
    if len(set(at)) < len(at):
        return df.orderBy(*order)
    ranges = F.split(F.lit(",".join(str(bisect_right(at, span)) for span in range(_SPANS))), ",").cast("array<int>")
    span = F.floor((F.unix_timestamp(F.col(order[0])) - lo) / width)
    place = F.get(ranges, F.greatest(F.lit(0), F.least(F.lit(_SPANS - 1), span)).cast("int"))
    place = F.when(F.col(order[0]).isNull(), 0).otherwise(place)  # NULL comes first
    return df.repartitionById(n, place).sortWithinPartitions(*order)


class _KeyRanks:
    """Looks up hash keys by rank.

    One scan counts the keys per prefix (at most 65,536 counts, since keys are hex digests);
    a second one sorts only the keys of the prefixes that hold a wanted rank.
    """

    def __init__(self, df: DataFrame, key: Column):
        self.keyed = df.select(key.alias("_key")).withColumn("_prefix", F.left("_key", F.lit(_PREFIX_DIGITS)))
        self.counts = sorted(self.keyed.groupBy("_prefix").count().collect())
        self.total = sum(n for _, n in self.counts)

    def at(self, ranks: Sequence[int]) -> list[str]:
        """The keys at 1-based ranks."""
        wanted, seen = {}, 0
        for prefix, n in self.counts:
            wanted.update({r: (prefix, r - seen) for r in ranks if seen < r <= seen + n})
            seen += n
        if len(wanted) != len(set(ranks)):
            raise ValueError(f"ranks {[r for r in ranks if r not in wanted]} lie outside the {self.total} rows")
        if not wanted:
            return []
        places = list(wanted.values())
        hit = F.lit(False)
        for prefix, place in places:
            hit = hit | ((F.col("_prefix") == prefix) & (F.col("_place") == place))
        placed = (
            self.keyed.where(F.col("_prefix").isin([p for p, _ in places]))
            .withColumn("_place", F.row_number().over(Window.partitionBy("_prefix").orderBy("_key")))
            .withColumn("_next", F.lead("_key").over(Window.partitionBy("_prefix").orderBy("_key")))
            .where(hit)
        )
        rows = placed.collect()  # one row per wanted rank
        if any(r["_key"] == r["_next"] for r in rows):
            raise ValueError("rows with equal keys lie on both sides of a cut; the key columns must tell all rows apart")
        found = {(r["_prefix"], r["_place"]): r["_key"] for r in rows}
        return [found[wanted[r]] for r in ranks]


def split_label(df: DataFrame, key_columns: Sequence[str], test_size: float, seed: int) -> Column:
    """``test`` for exactly ``ceil(n * test_size)`` rows of ``df``, drawn by seeded hash order, else ``train``.

    The label is a comparison with one key, so it can be put on any table with the key columns and
    no row is shuffled for it. ``key_columns`` must be unique per row.
    """
    key = hash_key(seed, *[F.col(c) for c in key_columns])
    ranks = _KeyRanks(df, key)
    n_test = math.ceil(ranks.total * test_size)
    if n_test == 0:
        return F.lit("train")
    return F.when(key <= ranks.at([n_test])[0], "test").otherwise("train")


def exact_split(df: DataFrame, key_columns: Sequence[str], test_size: float, seed: int) -> DataFrame:
    """Add ``split``, see :func:`split_label`."""
    return df.withColumn("split", split_label(df, key_columns, test_size, seed))


def contiguous_folds(df: DataFrame, key_columns: Sequence[str], k: int, seed: int, name: str = "fold") -> DataFrame:
    """Add a fold number 0…k-1: contiguous in hash order, the first ``n % k`` folds one row larger."""
    key = hash_key(seed, *[F.col(c) for c in key_columns])
    ranks = _KeyRanks(df, key)
    n = ranks.total
    if n < k:
        raise ValueError(f"cannot make {k} folds from {n} rows")
    ends, end = [], 0
    for fold in range(k - 1):
        end += n // k + (1 if fold < n % k else 0)
        ends.append(end)
    fold_number = F.lit(0)
    for edge in ranks.at(ends):
        fold_number = fold_number + (key > edge).cast("int")
    return df.withColumn(name, fold_number)


def head_condition(df: DataFrame, key_columns: Sequence[str], n: int, seed: int) -> Column:
    """True for the first ``n`` rows of ``df`` in hash order; 0 means all rows."""
    if n < 0:
        raise ValueError("the number of training records must be >= 0")
    if n == 0:
        return F.lit(True)
    key = hash_key(seed, *[F.col(c) for c in key_columns])
    ranks = _KeyRanks(df, key)
    return F.lit(True) if n >= ranks.total else key <= ranks.at([n])[0]


def head_rows(df: DataFrame, key_columns: Sequence[str], n: int, seed: int) -> DataFrame:
    return df.where(head_condition(df, key_columns, n, seed))


def every_nth(df: DataFrame, order: Sequence[str], parts: int = 10) -> DataFrame:
    """Evenly spaced rows in a total order: every ``max(1, n // parts)``-th one, from the first."""
    placed, n = _numbered(df, order, "position")
    step = max(1, n // parts)
    return placed.where(F.col("position") % step == 0)


def chunk_rows(df: DataFrame, order: Sequence[str], n_files: int, base: str) -> DataFrame:
    """Cut a work list into chunks of ``ceil(n / files)`` rows, with the chunk label as ``run_id``."""
    placed, n = _numbered(df, order, "position")
    if n == 0:
        return placed.withColumns({"chunk": F.lit(1), "run_id": F.lit(base)})
    n_files = min(n_files, n)
    size = math.ceil(n / n_files)
    number = (F.floor(F.col("position") / size) + 1).cast("int")
    label = F.lit(base) if n_files == 1 else F.concat(F.lit(base + "_"), number.cast("string"))
    return placed.withColumns({"chunk": number, "run_id": label})
