"""SimHash fingerprints of whole texts and groups of texts whose fingerprints differ in few bits.

Fingerprints. The words of a text, A-Z lower-cased, give shingles of ``n`` words, repeats included; a bit of the fingerprint is 1
if it is 1 in more than half of the shingles' XXH64 hashes. A block of texts is one byte array; the shingles are slices of it.

Links. Equal fingerprints are one node from the start. Others that differ in at most ``bits`` of 64 bits agree in
at least ``BLOCKS - bits`` of ``BLOCKS`` blocks, so each choice of that many blocks is a bucket key, and every pair of close
fingerprints shares a bucket. Buckets are joined with themselves, and a pair passes if its Hamming distance is small
enough: a condition of the join itself. Many near copies can share one bucket; in a bucket of more than ``BUCKET`` different
fingerprints no pairs are made. Its members are split once more, down to single bits: each takes as keys all values
within ``bits / 2`` of its own. Two fingerprints share such a key exactly if they are close enough, and a key can have no more
members than there are such values (65), so each key links its members to the smallest one. No link is lost either way:
the components are those of all pairs.

Defined results: null texts and texts without words have fingerprint zero and are linked like any other; fewer words than
``n`` are one shingle; every row is a document of its own, also where rows share an id or are repeated whole, and
its component is the smallest id reachable; null ids are never a component's name unless no other id is there; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.jaccard_join import components
from fieldcal.llm.scratch import saved
from fieldcal.llm.tokens import fold_case, one_blank, runs, text_blocks, word_class
from fieldcal.session import scratch_scope

#: Seed of the shingles' hash.
SEED = 42
#: Blocks of a fingerprint; any ``BLOCKS - bits`` of them form a bucket key of 42 bits or more.
BLOCKS = 6
#: Different fingerprints in a bucket that are compared in pairs.
BUCKET = 64
#: A fingerprint of more than one in so many rows is joined by broadcast; there are fewer than that many of them.
HOT = 64
_CHUNK = 1 << 15


def shingle_slices(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, one blank between two, and start, end and document of each shingle in it, by document."""
    word = word_class()[data]
    start, end, doc = runs(word, offsets)
    if not len(start):
        return b"", start, end, doc
    words, at, to = one_blank(fold_case()[data], word, start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    full = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    first = (np.cumsum(count) - count)[short]
    begin = np.concatenate([full, first])
    last = np.concatenate([full + n - 1, first + count[short] - 1])
    order = np.argsort(begin, kind="stable")
    begin, last = begin[order], last[order]
    return words, at[begin], to[last], doc[begin]


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each text."""
    words, start, end, doc = shingle_slices(data, offsets, n)
    ones, total = np.zeros((len(offsets) - 1, 64), np.int64), np.bincount(doc, minlength=len(offsets) - 1)
    for a in range(0, len(doc), _CHUNK):
        s, e, d = start[a : a + _CHUNK].tolist(), end[a : a + _CHUNK].tolist(), doc[a : a + _CHUNK]
        hashes = np.array([xxhash.xxh64_intdigest(words[i:j], SEED) for i, j in zip(s, e)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        ones[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """id, text → id, fp."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            found = fingerprints(data, offsets, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["id", "fp"])


def _masks(bits: int) -> list[int]:
    """The bits of every choice of ``BLOCKS - bits`` blocks, as signed 64-bit numbers."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(block, BLOCKS - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits of ``fp``."""
    flips = [sum(1 << i for i in chosen) for k in range(radius + 1) for chosen in combinations(range(64), k)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    return F.transform(F.array(*[F.lit(f) for f in signed]), lambda f: f.bitwiseXOR(fp))


def close_links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) of the different fingerprints ``fp``: same components as all pairs that differ in at most ``bits`` bits.

    ``bits`` is even, less than ``BLOCKS``.
    """
    if bits % 2 or not 0 < bits < BLOCKS:
        raise ValueError(f"bits is {bits}; it must be even, from 2 to {BLOCKS - 1}")
    masks = F.array(*[F.lit(m) for m in _masks(bits)])
    posted = prints.select("fp", F.posexplode(masks).alias("way", "mask")).select(
        "fp", "way", F.col("mask").bitwiseAND(F.col("fp")).alias("block")
    )
    buckets = posted.groupBy("way", "block").agg(F.count("*").alias("size")).filter("size > 1")
    members = saved(posted.join(buckets.hint("merge"), ["way", "block"]), "members")

    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= bits

    few = members.filter(F.col("size") <= BUCKET).select("way", "block", "fp")
    other = few.select(F.col("way").alias("way2"), F.col("block").alias("block2"), F.col("fp").alias("fp2"))
    pairs = few.join(
        other.hint("merge"),
        (F.col("way") == F.col("way2")) & (F.col("block") == F.col("block2")) & (F.col("fp") < F.col("fp2")) & near(F.col("fp"), F.col("fp2")),
    ).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    many = members.filter(F.col("size") > BUCKET).select("fp").distinct()
    # All members of a key differ from it in bits / 2 bits at most, so there are no more of them than values in the ball.
    balls = many.select("fp", F.explode(_ball(F.col("fp"), bits // 2)).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("all"))
    stars = balls.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return saved(pairs.unionAll(stars.filter((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b")))).distinct(), "links")


def simhash_components(docs: DataFrame, n: int = 5, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (fingerprint as a signed number), component_id of every row."""
    described = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch_scope(docs.sparkSession):
        described = saved(described.mapInArrow(lambda b: _describe(b, n), "id long, fp long"), "fingerprints", keep=True)
        prints = saved(described.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("times")), "prints")
        label = components(close_links(prints, bits))
        rooted = prints.join(label.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
        rooted = saved(rooted.select("fp", "first", "times", "root"), "rooted")
        # A component of one fingerprint has its name already.
        groups = rooted.filter("root <> fp").select("root").distinct()
        named = rooted.join(groups, "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
        known = saved(
            rooted.join(named.hint("merge"), "root", "left")
            .select(F.col("fp").alias("own"), "times", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")),
            "components", keep=True,
        )
    total = known.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") * HOT > total  # fewer than HOT fingerprints
    often, seldom = (known.filter(c).select("own", "component_id") for c in (hot, ~hot))
    told = described.join(F.broadcast(often), F.col("fp") == F.col("own"), "left")
    rest = described.join(F.broadcast(often), F.col("fp") == F.col("own"), "left_anti")
    return (
        told.filter("own is not null").select("id", "fp", "component_id")
        .unionAll(rest.join(seldom.hint("merge"), F.col("fp") == F.col("own")).select("id", "fp", "component_id"))
    )


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
