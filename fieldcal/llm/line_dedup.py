"""Removal of lines that spread over many sites.

A line is known by 128 bits of hash of its trimmed text. One aggregation keeps, per line, a HyperLogLog sketch of the
sites that hold it and its first place; sketches merge map-side, so a line that is everywhere is one
small row per task. Lines whose estimate lies clearly beyond the threshold are decided by the sketch;
those within its error band get an exact count of different sites. A line of at least ``min_sites`` sites is
boilerplate: its first occurrence (smallest id, then hash of the text, then position) stays, every other one goes.

Defined results: a null text stays null; blank lines are never boilerplate; a null site counts as no site; rows without
an id come last, by their texts, and rows that share an id in the order of a hash of the text; rows of the same id and text
are one document, which loses the same lines in each; a text may become empty, its row stays; an empty table gives no
rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.session import scratch_scope, stored

#: Sites that must hold a line for it to be boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers, and its relative standard error times four.
_LG_K = 12
_BAND = 4 * 1.04 / 2 ** (_LG_K / 2)


def _hash2(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def _with_keys(df: DataFrame, names: list[str], parts: list[Column]) -> DataFrame:
    return df.withColumns(dict(zip(names, _hash2(*parts))))


def _place() -> Column:
    """Place of an occurrence in the order of all documents; rows without an id are last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "pos")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Boilerplate among ``lines`` (h1, h2, site, id, k1, k2, pos): h1, h2 and the place of the first occurrence."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(_LG_K)).alias("sites"), F.min(_place()).alias("first"))
    low, high = min(min_sites - 1, min_sites * (1 - _BAND)), max(min_sites + 1, min_sites * (1 + _BAND))
    likely = stored(
        sketched.withColumn("estimate", F.hll_sketch_estimate("sites")).filter(F.col("estimate") >= low).drop("sites"),
        "likely",
    )
    near = likely.filter(F.col("estimate") <= high).select("h1", "h2")
    exact = (
        lines.filter(F.col("site").isNotNull()).join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    )
    sure = likely.filter(F.col("estimate") > high)
    return stored(sure.unionByName(likely.join(exact, ["h1", "h2"])).select("h1", "h2", "first"), "boilerplate")


def line_dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The documents without repeated boilerplate lines; ``counts`` names columns for lines before and lines removed."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = _with_keys(docs.select(row), ["k1", "k2"], [F.col("row").getField(id_col), F.col("row").getField(text_col)])
    text = F.col("row").getField(text_col)
    with scratch_scope(docs.sparkSession):
        lines = stored(
            keyed.select(
                "k1", "k2", F.col("row").getField(id_col).alias("id"), F.col("row").getField(site_col).alias("site"),
                F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
            )
            .withColumn("line", F.trim("line"))
            .filter(F.col("line") != "")
            .transform(lambda df: _with_keys(df, ["h1", "h2"], [F.col("line")]))
            .drop("line"),
            "lines",
        )
        common = boilerplate(lines, min_sites)
        gone = (
            lines.join(common, ["h1", "h2"])
            .filter(~_place().eqNullSafe(F.col("first")))
            .groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
        )
        gone = stored(gone, "gone", keep=True)
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.array_join(F.transform(F.array_except(at, "gone"), lambda i: F.col("lines")[i]), "\n")
    n_lines, n_gone = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size(F.coalesce("gone", F.array().cast("array<int>"))), F.lit(0))
    out = keyed.join(gone, ["k1", "k2"], "left").withColumn("lines", F.split(text, "\n", -1))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    columns[docs.columns.index(text_col)] = F.when(F.col("gone").isNull(), text).otherwise(left).alias(text_col)
    if counts:
        columns += [n_lines.cast("long").alias(counts[0]), n_gone.cast("long").alias(counts[1])]
    return out.select(*columns)
