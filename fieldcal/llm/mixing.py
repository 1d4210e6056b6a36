"""Mixing sources to target weights by systematic sampling.

Each source gets a target size; its documents then expect ``target / source size`` copies each. Within a
source the expected copies are summed up in an order, one random offset is added, and a document is emitted
once for each integer that the running sum crosses. The order is by size and then by a hash of the id, so every
stretch of the running sum holds documents of about one size and the words taken stay within a few
documents of the target. All documents of a source expect the same number of copies, so the running sum is
their place in the source times that number: no sum runs over a whole source in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources of size 0
have target 0 and emit nothing; rows repeated whole are documents of their own; an empty table gives no rows;
other columns are carried along untouched by ``mixed``, whatever their names. A rerun with the same seed gives the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.scratch import saved
from fieldcal.operators.ordering import with_positions
from fieldcal.session import scratch_scope, stored

#: Weights by the place of a source in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MOST = 3
_OFFSET_BITS = 20
#: A row that makes more than one in so many copies is dealt over many tasks; there are fewer than that many such rows.
_HOT = 1024
_CHUNK = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _offset(seed: int, source: Column) -> Column:
    """A multiple of 2^-20 in [0, 1) for each source."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, _OFFSET_BITS // 4), 16, 10).cast("double") / F.lit(float(1 << _OFFSET_BITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: size, number of documents, documents of earlier sources, weight, target.

    The targets share the size of the whole table by weight; a target over ``most`` times its source is cut
    there and what it loses is shared again. Rounds of one aggregation each, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = with_positions(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(placed.select("source", "source_size", "n", weight.alias("weight")), "sources")
    cap = F.lit(most) * F.col("source_size")
    share, capped = None, -1
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.lit(False) if share is None else cap <= F.lit(share) * F.col("weight")
        row = table.agg(
            F.sum(F.when(over, cap)).alias("cut"), F.sum(F.when(~over, F.col("weight"))).alias("rest"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not row["rest"] or row["n"] == capped:
            break
        capped, share = row["n"], (whole - (row["cut"] or 0)) / row["rest"]
    target = cap.cast("double") if share is None else F.least(cap.cast("double"), F.lit(share) * F.col("weight"))
    return table.withColumn("target", target)


def copies(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: key, size, source_size, target, n_copies, taken, and the columns of ``carry``."""
    sizes = stored(
        docs.select(
            F.col(key).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *carry
        ),
        "sizes",
    )
    targets = source_targets(sizes, weights, most)
    # A place in the whole order, less the first place of its source, is the place in the source.
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.md5(F.col("key").cast("string")), F.col("key")]
    placed = with_positions(sizes, order, "place")
    first = placed.groupBy("source").agg(F.min("place").alias("first"))
    by_source = stored(
        targets.alias("t").join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), "source_size", "target", "first"),
        "targets",
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    before = (F.col("place") - F.col("first")).cast("double")
    crossed = F.floor((before + 1) * F.col("ratio") + F.col("offset")) - F.floor(before * F.col("ratio") + F.col("offset"))
    return (
        placed.join(by_source, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("ratio", ratio)
        .withColumn("offset", _offset(seed, F.col("source")))
        .withColumn("n_copies", F.least(F.lit(most).cast("long"), crossed))
        .select(
            F.col("key").alias(key), "size", "source_size", "target", "n_copies",
            (F.col("n_copies") * F.col("size")).alias("taken"), *carry,
        )
    )


def _hashable(docs: DataFrame) -> list[Column]:
    return [F.to_json(F.col(f"`{c}`")) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes]


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed documents, each as often as it is taken, with their own columns.

    The order in a source is by a hash of key and row. Rows are known by key and 64 bits of hash of the row; rows repeated whole
    get the copies of all their places together, which makes the same rows. They are put together inside each task before
    the texts are shuffled, and a row of very many copies is copied by many tasks.
    """
    spark, names = docs.sparkSession, docs.columns
    text_col, source_col = options.get("text_col", "text"), options.get("source_col", "source")
    mark = F.struct(F.col(key).alias("key"), F.xxhash64(*_hashable(docs)).alias("hash")).alias("mark")
    with scratch_scope(spark):
        marked = docs.select(mark, F.col(text_col).alias("text"), F.col(source_col).alias("source"))
        options = {**options, "text_col": "text", "source_col": "source"}
        taken = copies(marked, "mark", **options).groupBy("mark").agg(F.sum("n_copies").alias("n")).filter("n > 0")
        taken = saved(taken.select("mark", "n", F.struct("mark.key", "mark.hash").alias("own")), "taken", keep=True)
    hot = F.col("n") * _HOT > (taken.agg(F.sum("n")).first()[0] or 0)
    rows = docs.select(mark, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def joined(some: DataFrame, counts: DataFrame) -> DataFrame:
        """One of the rows of each mark, with its number of copies."""
        one = some.groupBy(F.xxhash64("mark").alias("place"), "mark").agg(F.first("row").alias("row"))
        counts = counts.select(F.xxhash64("own").alias("at"), "own", "n").hint("merge")
        return one.join(counts, (F.col("place") == F.col("at")) & F.col("mark").eqNullSafe(F.col("own"))).select("row", "n")

    out = joined(rows, taken.filter(~hot)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    often = taken.filter(hot)
    if not often.isEmpty():
        few = F.broadcast(often.select("own"))  # fewer than _HOT rows
        many = joined(rows.join(few, F.col("mark").eqNullSafe(F.col("own")), "left_semi"), often)
        chunks = many.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(_CHUNK).cast("long"))))
        dealt = chunks.repartition(F.xxhash64(F.col("row").getField(key), "from"))
        last = F.least(F.col("from") + _CHUNK - 1, F.col("n"))
        out = out.unionByName(dealt.withColumn("copy", F.explode(F.sequence("from", last))).select("row", "n", "copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])
