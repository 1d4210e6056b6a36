"""Exact duplicates through an extendible-hash index in shared files.

Every text has a 64-bit hash. A *bucket* is a range of hash values: all hashes that share their first
``depth`` bits. The directory starts with one bucket; a bucket with more than ``capacity`` different hashes
is split by one more bit, which doubles the directory, until every bucket fits. The index entries (hash,
digest, document) are written to shared files in key order, so each owner task holds a range of keys and a
key with very many documents spans several tasks. The entries of a (bucket, hash) form a chain. A chain of one entry is a
document of its own, whatever its text. For longer chains the texts are compared byte by byte: each task first adds up its
own equal texts, so that a hot text travels as one row a task, and each different text becomes a node of its chain, with
the row that stays. Two texts of one hash (a collision) are two nodes. Every entry of the index then finds its node.

DataFrame functions only. Defined results: a null text counts as empty; empty texts are equal to each
other; rows repeated whole count as members of their group; rows with a null id count in ``group_size`` and
are kept only where no row of the group has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.session import stored

#: Different hashes in a bucket before it is split.
CAPACITY = 1024
_SPARE_BITS = 4


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Directory of the different hashes ``h`` in ``keys``: (slot, bucket, depth), and its number of bits.

    A slot is the first ``bits`` bits of a hash; ``bucket`` is 1 followed by the ``depth`` bits its hashes
    share. One count per slot serves all coarser depths. Should a slot itself be overfull, the directory is
    doubled further.
    """
    bits = min(48, max(0, math.ceil(math.log2(max(1, keys.count() / capacity)))) + _SPARE_BITS)
    while True:
        slots = stored(keys.groupBy(_prefix(F.col("h"), bits).alias("slot")).agg(F.count("*").alias("n")), "slots")
        levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn(
            "bucket", F.expr(f"shiftleft(1L, depth) + shiftright(slot, {bits} - depth)")
        )
        fitting = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n")).filter(F.col("n") <= capacity)
        placed = levels.join(fitting.select("depth", "bucket"), ["depth", "bucket"]).groupBy("slot").agg(
            F.min(F.struct("depth", "bucket")).alias("place")
        )
        found = stored(placed.select("slot", "place.bucket", "place.depth"), "directory")
        if found.count() == slots.count():
            return found, bits
        if bits >= 60:  # more than ``capacity`` hashes share 60 bits: such a slot is a bucket of its own
            own = F.lit(1 << bits) + F.col("slot")
            whole = slots.select("slot").join(found, "slot", "left")
            return whole.select("slot", F.coalesce("bucket", own).alias("bucket"), F.coalesce("depth", F.lit(bits)).alias("depth")), bits
        bits = min(60, bits + _SPARE_BITS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "h", F.xxhash64("text")
    )
    entries = stored(texts.select("id", "h", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")), "entries")
    keys = stored(entries.select("h").distinct(), "keys")
    slots, bits = directory(keys, capacity)
    index = stored(
        entries.withColumn("slot", _prefix(F.col("h"), bits))
        .join(slots, "slot")
        .select("bucket", "h", "sha", "id")
        .repartitionByRange("bucket", "h", "id")
        .sortWithinPartitions("bucket", "h", "id"),
        "index",
    )
    chains = index.groupBy("bucket", "h").agg(F.count("*").alias("entries")).filter("entries > 1")
    texts_of_one_hash = (
        texts.groupBy("h", "text")  # equal hash, then equal bytes; copies are added up before the shuffle
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("h", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), "keep_id", "group_size")
    )
    nodes = stored(texts_of_one_hash.join(chains, "h").drop("entries"), "nodes")
    alone = F.col("group_size").isNull()  # a chain of one entry, or one whose bytes no other text has
    return index.join(nodes, ["bucket", "h", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
