"""Jaccard self-join on word n-grams with rare-first prefix filtering.

Tokens. A document's set holds its distinct n-word shingles as 64-bit tokens. One pass counts all shingles of the corpus in
a table that grows with the corpus; the class of that count stands in the token's first bits, so the natural order of tokens
is rare-first and the same for all documents. Two documents of similarity t share a token among the first
``size - ceil(t * size) + 1`` of each (their prefixes).

Candidates. Documents with equal sets are one from the start. Prefix tokens of the others are joined; a pair passes if its
sizes allow t (length filter), if the tokens left after the shared one still allow it (positional filter, which
the first shared token of a true pair always passes), and if a sketch of the rest allows it (suffix filter: each
token flips one of ``SKETCH_LONGS * 64`` bits, so the differing bits of two sketches are at most the differing tokens of two
sets). These are conditions of the join itself. Each pair that is left is verified once on the whole sets.

Groups. Many documents may share a rare token, such as the copies of one page with small changes. So a first round
pairs each document only with a few pivots of its token, and joins what they link. Tokens whose documents
are now one component need nothing more; the second round pairs the documents of the other tokens, each pair
of different components, by the same filters. No link between different texts is lost: a pair is skipped only if
its documents are in one component already.

Defined results: null texts and texts without words have no shingles and are linked with nothing; fewer words than
n are one shingle; rows that share an id are one document per different text, and their component is the smallest
id reachable; rows repeated whole give a row each; rows with a null id are returned with their own set size and a null
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.scratch import saved
from fieldcal.llm.tokens import fold_case, list_array, mix, runs, text_blocks, word_class, word_hash
from fieldcal.session import scratch_scope

#: log2 of the places in the table of shingle counts: one for so many bytes of text, from the least to the most.
PLACE_BYTES = 1024
LEAST_BITS, MOST_BITS = 16, 22
#: 64-bit words of the sketch of the suffix filter.
SKETCH_LONGS = 8
_CHUNK = 1 << 14
#: Parts of the rows that are repeated whole.
_SALTS = 16
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle, in the order of the text; repeated ones are not removed."""
    start, end, doc = runs(word_class()[data], offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = word_hash(fold_case()[data], start, end, 11)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    hashes, docs = [], []
    for length in range(1, n + 1):
        if length < n:  # the whole of a short text
            docs.append(np.flatnonzero(count == length))
            at = first[docs[-1]]
        else:
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
            docs.append(doc[at])
        h = np.full(len(at), length, np.uint64)
        for k in range(length):
            h = mix(h * _ODD + words[at + k])
        hashes.append(h)
    return np.concatenate(hashes), np.concatenate(docs)


def _pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs."""
    kind = next((k for k in ("<u1", "<u2", "<u4") if counts.max() <= np.iinfo(k).max), "<i8")
    return counts.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(data) // _CHUNK])


def _count(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << bits, np.uint32)  # any count gives a right order
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            hashes, _ = shingles(data, offsets, n)
            places, times = np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            total[places] += times.astype(np.uint32)
    for at in range(0, len(total), _CHUNK):
        part = total[at : at + _CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([at // _CHUNK], pa.int32()), pa.array([_pack(part)], pa.binary())], ["chunk", "counts"]
            )


def _add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CHUNK, np.int64)
    for table in tables:
        for part in table.column("counts"):
            total += _unpack(part.as_py())
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([_pack(total)], pa.binary())], ["chunk", "counts"]
    )


def rarity(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Class 0 to 255 of the corpus count of each place of the count table: eight classes for each doubling."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / PLACE_BYTES)))))
    partial = docs.select(F.col(text_col)).mapInArrow(lambda b: _count(b, n, bits), "chunk int, counts binary")
    # Added up in two steps, so that no task adds the counts of all tasks.
    salted = partial.withColumn("part", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(64)))
    halfway = salted.groupBy("chunk", "part").applyInArrow(_add, "chunk int, counts binary")
    total = np.zeros(1 << bits, np.int64)
    for row in halfway.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").toLocalIterator():  # 2 ** bits counts in all
        total[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = _unpack(bytes(row["counts"]))
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)


def _token_sets(data: np.ndarray, offsets: np.ndarray, n: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents in turn, each document's ascending and distinct, and their numbers."""
    hashes, doc = shingles(data, offsets, n)
    rare = classes[(hashes >> np.uint64(65 - len(classes).bit_length())).astype(np.int64)].astype(np.uint64)
    tokens = (rare << np.uint64(56)) | (mix(hashes) >> np.uint64(8))
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    if (np.diff(doc) < 0).any():
        tokens = tokens[np.argsort(doc, kind="stable")]
    parts, sizes, at = [tokens[:0]], np.zeros(len(counts), np.int64), 0
    for i, c in enumerate(counts.tolist()):
        if c:
            parts.append(np.unique(tokens[at : at + c]))
            sizes[i] = len(parts[-1])
            at += c
    return np.concatenate(parts), sizes


def _per_segment(ufunc, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = ufunc.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _describe(batches, n: int, num: int, den: int, classes) -> Iterator[pa.RecordBatch]:
    """id, mark, text → id, mark, set signature, size, prefix tokens, sketch."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(2)):
            tokens, sizes = _token_sets(data, offsets, n, classes.value)
            first = np.cumsum(sizes) - sizes
            # A set that even one more token makes too different has no partner but its equal.
            prefix = np.where(den * sizes >= num * (sizes + 1), sizes - -(-num * sizes // den) + 1, 0)
            prefix[sizes == 0] = 0
            within = np.arange(len(tokens)) - np.repeat(first, sizes)
            head = tokens[within < np.repeat(prefix, sizes)]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bits = SKETCH_LONGS * 64
            flips = np.bincount(owner * bits + (tokens % np.uint64(bits)).astype(np.int64), minlength=len(sizes) * bits)
            sketch = np.packbits((flips & 1).astype(bool)).view(np.int64)
            keys = [batch.column(i).slice(a, b - a) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *keys,
                    pa.array(_per_segment(np.add, mix(tokens), sizes).view(np.int64)),
                    pa.array(_per_segment(np.bitwise_xor, mix(tokens ^ _ODD), sizes).view(np.int64)),
                    pa.array(sizes), list_array(head.view(np.int64), prefix, pa.int64()),
                    list_array(sketch, np.full(len(sizes), SKETCH_LONGS), pa.int64()),
                ],
                ["id", "mark", "s1", "s2", "n", "prefix", "sketch"],
            )


def _sets(batches, n: int, classes) -> Iterator[pa.RecordBatch]:
    """node, text → node, tokens as bytes."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            tokens, sizes = _token_sets(data, offsets, n, classes.value)
            where = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes * 8, out=where[1:])
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(where), pa.py_buffer(tokens.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed], ["node", "tokens"])


def _verify(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """a, b, tokens of both → a, b of the pairs that are similar enough."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([p, q]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if den * common >= num * (len(p) + len(q) - common):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of that label; long chains shrink by half
    or more in a round.
    """
    edges = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        closer = saved(closer, "closer")
        jump = closer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = saved(
            closer.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels"
        )
        if after.filter("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


#: Columns that tell sets apart.
_SIGNATURE = ["s1", "s2", "n"]


def _key() -> Column:
    """Number of a set, from its smallest id and its signature."""
    return F.xxhash64("node", *_SIGNATURE)


def _linked(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, ...]:
    """Rows with the signature of their sets, node (smallest id) of each set, key and node of each set, links of keys."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(rarity(rows, "text", n))  # 2 ** MOST_BITS bytes at most
    schema = "id long, mark long, s1 long, s2 long, n long, prefix array<long>, sketch array<long>"
    described = saved(rows.mapInArrow(lambda b: _describe(b, n, num, den, classes), schema), "described")

    # One node for each different set: its smallest id (and that row's text).
    signature = _SIGNATURE
    real = described.filter("n > 0 and id is not null")
    nodes = saved(real.groupBy(*signature).agg(F.min("id").alias("node")), "nodes")
    # An id with several different sets stands for several nodes of the same number, which are then one.
    heads = real.join(nodes, signature).filter("id = node")
    held = heads.groupBy("node", *signature).agg(F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("mark").alias("mark"))
    held = saved(held.withColumn("key", _key()), "held")
    with scratch_scope(spark):
        posted = held.select("key", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = saved(posted.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token"), "shared")
        postings = saved(posted.join(shared.hint("merge"), "token"), "postings")
        postings = saved(postings.join(held.select("key", "sketch").hint("merge"), "key"), "sketched", keep=True)

    def fit(a: dict[str, Column], b: dict[str, Column]) -> Column:
        """Length, positional and suffix filter."""
        whole = a["n"] + b["n"]
        rest = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
        differing = sum((F.bit_count(F.get(a["sketch"], F.lit(i)).bitwiseXOR(F.get(b["sketch"], F.lit(i)))) for i in range(SKETCH_LONGS)), F.lit(0))
        return (
            (den * F.least(a["n"], b["n"]) >= num * F.greatest(a["n"], b["n"])) & ((num + den) * rest >= num * whole)
            & ((num + den) * differing <= (den - num) * whole)
        )

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b) of keys, by comparison of the whole sets."""
        with scratch_scope(spark):
            involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            wanted = saved(involved.join(held.select("key", "node", "mark"), "key"), "involved")
            texts = rows.join(wanted.hint("merge"), (F.col("id") == F.col("node")) & (rows["mark"] == wanted["mark"])).select("key", "text")
            sets = texts.dropDuplicates(["key"]).mapInArrow(lambda b: _sets(b, n, classes), "node long, tokens binary")
            sets = saved(sets, "sets")
            whole = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").hint("merge").join(
                sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"
            )
            return saved(whole.select("a", "b", "ta", "tb").mapInArrow(lambda b: _verify(b, num, den), "a long, b long"), "links", keep=True)

    def one_way(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # First round: every document with three pivots of each of its tokens.
    place = F.struct("n", "key", "pos", "sketch")
    pivots = postings.groupBy("token").agg(
        F.min(place).alias("p0"), F.max(place).alias("p1"), F.min_by(place, F.xxhash64("key", "token")).alias("p2")
    )
    pivots = saved(pivots.select("token", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("p")), "pivots")
    own = {c: F.col(c) for c in ("n", "pos", "sketch")}
    star = postings.join(
        pivots.withColumnRenamed("token", "t").hint("merge"),
        (F.col("token") == F.col("t")) & (F.col("key") != F.col("p.key")) & fit(own, {c: F.col(f"p.{c}") for c in own}),
    )
    star = saved(one_way(star.select(F.col("key").alias("a"), F.col("p.key").alias("b"))), "star")
    links = verified(star)
    label = components(links)

    # Second round: tokens that hold more than one component, pairs of different components.
    marked = saved(
        postings.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), "marked"
    )
    mixed = saved(
        marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token"), "mixed"
    )
    left = saved(marked.join(mixed.hint("merge"), "token"), "left")
    other = left.select(*[F.col(c).alias(f"_{c}") for c in left.columns])
    rest = left.join(
        other.hint("merge"),
        (F.col("token") == F.col("_token")) & (F.col("key") < F.col("_key")) & (F.col("label") != F.col("_label"))
        & fit(own, {c: F.col(f"_{c}") for c in own}),
    )
    rest = one_way(rest.select(F.col("key").alias("a"), F.col("_key").alias("b")))
    links = links.unionAll(verified(saved(rest.join(star, ["a", "b"], "left_anti"), "rest")))
    return described, nodes, held.select("key", "node"), links


def jaccard_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, mark (hash of the text), n_shingles, component_id of every row; similarity is at least num / den.

    ``id_col`` holds whole numbers.
    """
    with scratch_scope(docs.sparkSession):
        described, nodes, ids, links = _linked(docs, n, num, den, id_col, text_col)
        signature = _SIGNATURE
        real = described.filter("n > 0 and id is not null").select("id", *signature).distinct()
        # Links of keys become links of ids; an id with several sets joins their components.
        named = links.join(ids.withColumnRenamed("key", "a").withColumnRenamed("node", "u"), "a").join(
            ids.withColumnRenamed("key", "b").withColumnRenamed("node", "v"), "b"
        )
        several = real.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
        ties = real.join(several, "id").join(nodes, signature).filter("id <> node").select("id", "node").distinct()
        named = named.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(ties.toDF("a", "b"))
        final = components(named.filter("a <> b"))
        found = (
            described.select("id", "mark", *signature).join(nodes, signature, "left")
            .withColumn("node", F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("node", "id")))
            .join(final, "node", "left")
            .select("id", "mark", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))
        )
        return saved(found, "components", keep=True)


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row stays: that of the smallest id, of its texts that of the smallest mark, of equal rows one.

    A row belongs to a component by its own set: rows that share an id are judged each by its text. Rows whose text has no
    words, or without an id, all stay.
    """
    with scratch_scope(docs.sparkSession):
        described, nodes, _, links = _linked(docs, n, num, den, id_col, text_col)
        label = components(links)
        sets = nodes.withColumn("key", _key()).join(label.withColumnRenamed("node", "key"), "key", "left")
        sets = sets.select(*_SIGNATURE, F.coalesce("label", "key").alias("component"))
        found = described.filter("n > 0 and id is not null").select("id", "mark", *_SIGNATURE).join(sets, _SIGNATURE)
        texts = saved(found.groupBy("id", "mark", "component").agg(F.count("*").alias("times")), "texts")
        first = texts.groupBy("component").agg(F.min(F.struct("id", "mark")).alias("first")).select("first.id", "first.mark")
        first = saved(first, "first")
        own = ["id", "mark"]
        gone = saved(texts.join(first, own, "left_anti").select(*own), "gone", keep=True)
        again = saved(texts.filter("times > 1").join(first, own, "left_semi").select(*own), "again", keep=True)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(text_col)).alias("mark"),
    )
    # Rows of one text are dealt by a salt; each task then drops its own repeats before the texts meet.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    once = rows.withColumn("salt", salt).join(salted, [*own, "salt"], "left_semi").drop("salt").dropDuplicates(own)
    left = rows.join(gone.unionAll(again), own, "left_anti").unionByName(once)
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
