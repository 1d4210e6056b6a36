"""Removal of repeated byte strings, by prefix doubling on sampled suffix positions.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or
earlier in the same one. All positions of a corpus times several rounds would be many times the corpus, so the
suffix positions that take part are *sampled by content*: of each window of ``length`` bytes the start of its
least ``seed`` bytes (by hash; the leftmost of equal ones). Equal windows choose the same position at the same
offset. Neighbouring windows mostly choose the same one: the run of windows that share it is a *stretch*.

Round 1 ranks the sampled positions by their first ``seed`` bytes. A position whose rank is unique leaves.
Round 2 ranks, at a larger offset, the pair of that rank and the rest of the stretch. Of positions with equal pairs all
windows of the later ones repeat those of the first; no window need be looked at. Each task settles its own
equal pairs before the shuffle.
Round 3 takes the first positions of a rank that has different pairs. Their windows are ranked in groups of
``STEP`` neighbours by the bytes that the group has in common; unique groups leave.
Round 4, at the threshold: windows of ``length`` bytes are ranked, and all but the earliest of a rank are repeats.

Ranks are 64-bit hashes of the bytes (128 bits where equality decides), so a rank needs no table of earlier ranks.

Defined results: a null text is empty; a text shorter than ``length`` loses nothing; the input alone is judged, not what
is left; rows that share an id are one place, none of them earlier than another; inside a text the earlier start is
earlier; null ids come before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.scratch import saved
from fieldcal.llm.tokens import byte_values, mix, powers, prefix_hash, ranges, span_hash, text_blocks

LENGTH = 100
#: Bytes by which positions are chosen and first ranked; windows that round 3 ranks as one.
SEED = 50
STEP = 12
_MOST_WINDOWS = 46_340  # of a stretch, so that its shape fits into 32 bits


def _base(length: int, seed: int) -> int:
    """Base of a stretch's shape: (place of the position in it) * base + (number of windows, less than base)."""
    width = length - seed + 1
    if not (seed > 0 and 0 < width <= _MOST_WINDOWS):
        raise ValueError(f"length - seed + 1 must be in 1 to {_MOST_WINDOWS} and seed positive: length {length}, seed {seed}")
    return width + 1


def _rolling(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place."""
    count = max(0, len(prefix) - size)
    return mix((prefix[size:] - prefix[:count]) * powers(len(prefix))[1][:count])


def _chosen(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest key (by its first 32 bits) in each run of ``width`` keys."""
    count, rows = len(keys) - width + 1, -(-len(keys) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(keys)] = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    grid = grid.reshape(rows, width)
    # A run of keys is the end of one row of the grid and the beginning of the next.
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:count], left[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def stretches(keys: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows and chosen position of each stretch, as places in the block."""
    width = length - seed + 1
    empty = np.zeros(0, np.int64)
    if len(keys) < width:
        return empty, empty, empty, empty
    at = _chosen(keys, width)
    whole = np.ones(len(at), bool)  # windows that lie in one document
    inner = offsets[1:-1]
    low = np.maximum(inner - length + 1, 0)
    cut = ranges(low, inner - low)
    whole[cut[cut < len(at)]] = False
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    edge = np.flatnonzero(edge)
    first, count = edge[:-1], np.diff(edge)
    first, count = first[whole[first]], count[whole[first]]
    return np.searchsorted(offsets, first, side="right") - 1, first, count, at[first]


def _settled(ids: np.ndarray, doc: np.ndarray, place: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """Rows of a block that repeat an earlier row of equal rank: one of a smaller id, or earlier in the same text."""
    out = np.zeros(len(place), bool)
    if len(place):
        owner = ids[doc]
        order = np.lexsort((place, doc, owner, *ranks))
        fresh = np.zeros(len(order), bool)
        fresh[0] = True
        for r in ranks:
            fresh[1:] |= r[order][1:] != r[order][:-1]
        lead = order[fresh][np.cumsum(fresh) - 1]
        same_doc = np.append([False], (doc[order][1:] == doc[order][:-1]) & ~fresh[1:])
        out[order] = (owner[order] > owner[lead]) | same_doc
    return out


def _block(batch: pa.RecordBatch, column: int, seed: int, length: int):
    for a, b, data, offsets in text_blocks(batch.column(column)):
        prefix = prefix_hash(data, byte_values(17, fold_case=False))
        keys = _rolling(prefix, seed)
        doc, first, count, at = stretches(keys, offsets, length, seed)
        if len(doc):
            yield a, b, offsets, prefix, keys, doc, first, count, at


def _seeds(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """text → rank of each sampled position."""
    for batch in batches:
        for _, _, _, _, keys, _, _, _, at in _block(batch, 0, seed, length):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64))], ["r1"])


def _pairs(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """id, key, text → rank, pair, document, stretch of each sampled position, and whether its block settles it."""
    base = _base(length, seed)
    for batch in batches:
        ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
        for a, b, offsets, prefix, keys, doc, first, count, at in _block(batch, 2, seed, length):
            r1 = keys[at]
            r2 = mix(span_hash(prefix, first, first + count - 1 + length) ^ mix((at - first).astype(np.uint64)))
            place = first - offsets[doc]
            arrays = [
                r1.view(np.int64), r2.view(np.int64), ids[a + doc], marks[a + doc], place.astype(np.int32),
                ((at - first) * base + count).astype(np.int32), _settled(ids[a:b], doc, place, r2, r1),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["r1", "r2", "id", "key", "first", "shape", "settled"])


def _lists(batch: pa.RecordBatch, a: int, b: int, *columns: int) -> tuple[np.ndarray, ...]:
    """Row in the block of each element of list columns of equal lengths, and the elements."""
    parts = [batch.column(c).slice(a, b - a) for c in columns]
    doc = np.repeat(np.arange(b - a), np.diff(np.asarray(parts[0].offsets)))
    return doc, *(p.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for p in parts)


def _groups(batches: Iterator[pa.RecordBatch], length: int, base: int) -> Iterator[pa.RecordBatch]:
    """id, key, text, firsts, shapes → rank, document, first window and number of windows of each group of neighbours."""
    for batch in batches:
        ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
        for a, b, data, offsets in text_blocks(batch.column(2)):
            doc, first, shape = _lists(batch, a, b, 3, 4)
            back, count = shape // base, shape % base
            # Windows by their distance before the position: from back - count + 1 to back, in steps.
            low = (back - count + 1) // STEP
            steps = back // STEP - low + 1
            which = np.repeat(np.arange(len(doc)), steps)
            step = ranges(low, steps)
            at = (first + back + offsets[doc])[which]
            prefix = prefix_hash(data, byte_values(23, fold_case=False))
            start, stop = at - step * STEP, at - step * STEP - STEP + 1 + length
            rank = mix(span_hash(prefix, start, stop) ^ mix(step.astype(np.uint64)))
            near = np.maximum(step * STEP, (back - count + 1)[which])
            far = np.minimum(step * STEP + STEP - 1, back[which])
            where = (first + back)[which] - far
            owner = a + doc[which]
            arrays = [rank.view(np.int64), ids[owner], marks[owner], where.astype(np.int32), (far - near + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rank", "id", "key", "first", "count"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """id, key, text, firsts, counts → rank of each window (two hashes), its document and place, whether its block settles it."""
    for batch in batches:
        ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
        for a, b, data, offsets in text_blocks(batch.column(2)):
            doc, first, count = _lists(batch, a, b, 3, 4)
            place, doc = ranges(first, count), np.repeat(doc, count)
            at = place + offsets[doc]
            w1, w2 = (span_hash(prefix_hash(data, byte_values(s, fold_case=False)), at, at + length) for s in (29, 31))
            arrays = [
                w1.view(np.int64), w2.view(np.int64), ids[a + doc], marks[a + doc], place.astype(np.int32),
                _settled(ids[a:b], doc, place, w2, w1),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["w1", "w2", "id", "key", "first", "settled"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """id, text, firsts, counts (runs of repeated windows) → id, size, removed spans, what is left."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            n = b - a
            doc, first, count = _lists(batch, a, b, 2, 3)
            start = first + offsets[doc]
            depth = np.bincount(start, minlength=len(data) + 1)
            depth -= np.bincount(start + count - 1 + length, minlength=len(data) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True  # a span ends with its document
            begins = np.flatnonzero(gone & (edge[:-1] | ~np.append([False], gone[:-1])[: len(gone)]))
            ends = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], [False])[: len(gone)])) + 1
            owner = np.searchsorted(offsets, begins, side="right") - 1
            at = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=n), out=at[1:])
            span = [pa.array(begins - offsets[owner], pa.int64()), pa.array(ends - offsets[owner], pa.int64())]
            spans = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(span, ["start", "end"]))
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(left), pa.py_buffer(data[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, n), pa.array(np.diff(offsets)), spans, kept], ["id", "n_bytes", "spans", "kept"]
            )


def _per_document(rows: DataFrame, *values: str) -> DataFrame:
    """id, key and one list for each of ``values``, in the order of the first; a list is as long as its text at most."""
    packed = rows.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct(*values))).alias("s"))
    return packed.select(F.col("id").alias("_id"), F.col("key").alias("_key"), *[F.col(f"s.{v}").alias(v + "s") for v in values])


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """id, key, first, count: runs of windows that also start earlier. ``docs`` has id, key (no nulls) and text (binary)."""

    base = _base(length, seed)

    def with_texts(lists: DataFrame) -> DataFrame:
        own = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))
        return docs.join(lists, own).select("id", "key", "text", *lists.columns[2:])

    # Round 1
    seeds = docs.select("text").mapInArrow(lambda b: _seeds(b, length, seed), "r1 long")
    ranks = saved(seeds.groupBy("r1").agg(F.count("*").alias("n")).filter("n > 1").select("r1"), "ranks")
    # Round 2
    schema = "r1 long, r2 long, id long, key long, first int, shape int, settled boolean"
    pairs = saved(docs.mapInArrow(lambda b: _pairs(b, length, seed), schema).join(ranks, "r1", "left_semi"), "pairs")
    count = F.col("shape") % base
    settled = pairs.filter("settled").select("id", "key", "first", count.alias("count"))
    equal = pairs.filter("not settled").groupBy("r1", "r2").agg(F.min("id").alias("least"), F.count("*").alias("times"))
    equal = saved(equal, "equal")
    several = saved(equal.groupBy("r1").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("r1", "kinds"), "several")
    equal = equal.join(several, "r1", "left").filter("times > 1 or kinds is not null")
    equal = saved(equal.select("r1", "r2", "least", F.col("kinds").isNotNull().alias("open")), "leads")
    judged = pairs.filter("not settled").join(equal, ["r1", "r2"]).filter("id > least or open")
    judged = saved(judged.select("id", "key", "first", "shape", (F.col("id") > F.col("least")).alias("again")), "judged")
    again = judged.filter("again").select("id", "key", "first", count.alias("count"))
    # Round 3
    texts = with_texts(_per_document(judged.filter("not again"), "first", "shape"))
    groups = saved(
        texts.mapInArrow(lambda b: _groups(b, length, base), "rank long, id long, key long, first int, count int"), "groups"
    )
    ranks = saved(groups.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank"), "group_ranks")
    shared = saved(groups.join(ranks, "rank", "left_semi").select("id", "key", "first", "count"), "shared")
    # Round 4
    schema = "w1 long, w2 long, id long, key long, first int, settled boolean"
    windows = saved(with_texts(_per_document(shared, "first", "count")).mapInArrow(lambda b: _windows(b, length), schema), "windows")
    least = windows.filter("not settled").groupBy("w1", "w2").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    least = saved(least.filter("n > 1").select("w1", "w2", "least"), "least")
    late = windows.filter("not settled").join(least, ["w1", "w2"]).filter("id > least")
    late = late.select("id", "key", "first").unionAll(windows.filter("settled").select("id", "key", "first"))
    return settled.unionAll(again).unionAll(late.withColumn("count", F.lit(1)))


def substring_dedup(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_bytes, spans removed (start, end), kept (binary)."""
    first = -(1 << 63)  # stands for a null id
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(first)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.select("id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    found = saved(_per_document(repeated_windows(rows, length, seed), "first", "count"), "found")
    none = F.array().cast("array<int>")
    own = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))
    whole = rows.join(found, own, "left").select(
        "id", "text", F.coalesce("firsts", none).alias("firsts"), F.coalesce("counts", none).alias("counts")
    )
    schema = "id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    cut = whole.mapInArrow(lambda b: _cut(b, length), schema)
    return cut.withColumn("id", F.when(F.col("id") > F.lit(first), F.col("id"))).withColumnRenamed("id", id_col)
