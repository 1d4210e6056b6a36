"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Word vectors come from random indexing: each word (hashed to one of ``BUCKETS``) has a sparse random index vector,
and its word vector is the sum of the index vectors of its neighbours over the whole corpus. Tasks add up one
matrix of fixed size each; the matrices are summed by Spark in row blocks, so what reaches the driver is one
matrix whatever the corpus. A document is pooled into the mean of its word vectors, the mean of its index vectors,
the mean likeness of neighbouring words, and its length. A two-layer network on the pooled vector is trained with numpy
on a bounded sample of labelled documents (``SAMPLE_ROWS``, chosen by hash of the id); one part of the sample is
held back to find the temperature that calibrates its probabilities.

A word is a run of letters, of digits, or of other visible characters.

Defined results: null and empty texts have the pooled vector 0 and get a score like any other; without labels of both
kinds the score is the share of label 1 (0.5 without labels); rows repeated whole get the same score; several labels
of one id count as their largest; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.tokens import byte_values, list_array, mix, prefix_hash, runs, span_hash, text_blocks
from fieldcal.session import stored

#: Hashed words, length of a vector, non-zero entries of an index vector, neighbours on each side.
BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
WINDOW = 2
#: Labelled documents the network may be trained on.
SAMPLE_ROWS = 20_000
HIDDEN = 24
EPOCHS = 60
_CHUNK = 256  # rows of the matrix that are summed as one
_PARTS = 2 * DIMS + 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(256, 3, np.uint8)
    table[[*range(0x00, 0x21), 0x7F]] = 0
    table[0x30:0x3A] = 2
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    return table


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, one for each bucket, and zeros for "no word"."""
    out = np.zeros((BUCKETS + 1, DIMS), np.float32)
    bucket = np.arange(BUCKETS, dtype=np.uint64)
    for k in range(NONZERO):
        h = mix(bucket * np.uint64(NONZERO) + np.uint64(k + 1))
        out[np.arange(BUCKETS), (h % np.uint64(DIMS)).astype(int)] += np.where(h >> np.uint64(63), 1.0, -1.0)
    return out


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word."""
    start, end, doc = runs(_classes()[data], offsets)
    hashed = span_hash(prefix_hash(data, byte_values(3, fold_case=False)), start, end)
    return (hashed % np.uint64(BUCKETS)).astype(np.int32), doc


def _add_contexts(total: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> None:
    """Add the index vectors of each word's neighbours to the row of its bucket."""
    vectors = index_vectors()
    n = len(bucket)
    pairs = []
    for gap in range(1, WINDOW + 1):
        if n <= gap:
            continue
        same = doc[gap:] == doc[:-gap]
        left, right = bucket[:-gap][same].astype(np.int64), bucket[gap:][same].astype(np.int64)
        pairs += [left * BUCKETS + right, right * BUCKETS + left]
    if not pairs:
        return
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)  # each pair of words once
    word = pair // BUCKETS
    first = np.flatnonzero(np.diff(word, prepend=-1))
    weighted = vectors[pair % BUCKETS] * times[:, None].astype(np.float32)
    total[word[first]] += np.add.reduceat(weighted, first, axis=0)


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS, DIMS), np.float64)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0)):
            _add_contexts(total, *_buckets(data, offsets))
    for chunk in range(0, BUCKETS, _CHUNK):
        rows = total[chunk : chunk + _CHUNK]
        if rows.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk // _CHUNK], pa.int32()), pa.array([rows.astype("<f8").tobytes()], pa.binary())], ["chunk", "sums"]
            )


def _sum_chunks(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CHUNK * DIMS)
    for table in tables:
        for part in table.column("sums"):
            total += np.frombuffer(part.as_py(), "<f8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vector of every bucket, from the contexts of the whole corpus."""
    partial = docs.select(F.col(text_col)).mapInArrow(_count_contexts, "chunk int, sums binary")
    # Two steps, so that no task sums more than its share of the tasks' matrices.
    salted = partial.withColumn("part", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(64)))
    halfway = salted.groupBy("chunk", "part").applyInArrow(_sum_chunks, "chunk int, sums binary")
    out = np.zeros((BUCKETS // _CHUNK, _CHUNK, DIMS))
    for row in halfway.groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, sums binary").collect():  # of fixed size
        out[row["chunk"]] = np.frombuffer(row["sums"], "<f8").reshape(_CHUNK, DIMS)
    vectors = out.reshape(BUCKETS, DIMS)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    common = (vectors / np.maximum(norms, 1e-9)).sum(axis=0) / max(1, int((norms > 0).sum()))
    vectors = np.where(norms > 0, vectors / np.maximum(norms, 1e-9) - common, 0)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool_block(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, _PARTS), np.float32)
    bucket, doc = _buckets(data, offsets)
    if not len(bucket):
        return out
    index = index_vectors()
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    which, count = doc[first], np.diff(np.append(first, len(doc)))
    own = index[bucket]
    out[which, :DIMS] = np.add.reduceat(words[bucket], first, axis=0) / count[:, None]
    out[which, DIMS : 2 * DIMS] = np.add.reduceat(own, first, axis=0) / count[:, None]
    alike = np.zeros(len(bucket), np.float32)
    alike[1:] = np.einsum("ij,ij->i", own[1:], own[:-1]) * (doc[1:] == doc[:-1])
    out[which, 2 * DIMS] = np.add.reduceat(alike, first) / count / NONZERO
    out[which, 2 * DIMS + 1] = np.log1p(count) / 8
    out[which, 2 * DIMS + 2] = np.linalg.norm(out[which, :DIMS], axis=1)
    return out


def pooled(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash of the text and pooled vector of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # BUCKETS x DIMS floats, a fixed size

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                values = _pool_block(data, offsets, shared.value)
                lists = list_array(values.ravel(), np.full(b - a, _PARTS), pa.float32())
                keys = [batch.column(i).slice(a, b - a) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, lists], ["id", "mark", "pooled"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.xxhash64(F.col(text_col)).alias("__mark"), text_col)
    return rows.mapInArrow(pool, f"id {kind}, mark long, pooled array<float>")


class Network:
    """Two layers, tanh between them, and a temperature on the result."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2
        self.temperature = temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 1, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Fit by Adam on nine tenths of the rows; the last tenth gives the temperature."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 10 == 9
    x = x.astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    net = Network(
        mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, hidden**-0.5, hidden), np.float64(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))),
    )
    names = ("w1", "b1", "w2", "b2")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    fit, t = np.flatnonzero(~held), 0
    z = (x - mean) / scale
    for epoch in range(epochs):
        order, rate = rng.permutation(fit), 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        for a in range(0, len(order), 256):
            rows, t = order[a : a + 256], t + 1
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            d = (_sigmoid(h @ net.w2 + net.b2) - y[rows]) / len(rows)
            back = np.outer(d, net.w2) * (1 - h * h)
            grads = {"w1": z[rows].T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * net.w2, "b2": d.sum()}
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, getattr(net, k) - step)
    if held.any():
        logits = net.logits(x[held])
        net.temperature = min(np.exp(np.linspace(-1.5, 2.0, 71)), key=lambda c: _loss(logits / c, y[held]))
    return net


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    learn_from: Column | None = None, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """id, mark (hash of the text) and score (0 to 1, higher: label 1 likelier) of every row of ``docs``.

    ``learn_from`` selects the rows of ``labels`` whose labels may be learnt.
    """
    known = labels if learn_from is None else labels.filter(learn_from)
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    table = stored(pooled(docs, word_vectors(docs, text_col), id_col, text_col), "pooled")
    sample = table.join(F.broadcast(stored(known, "labels")), "id")  # at most sample_rows rows
    rows = sample.orderBy(F.xxhash64("id"), "id", F.xxhash64("pooled")).limit(sample_rows).select("label", "pooled").toPandas()
    y = (rows["label"].to_numpy(float) > 0).astype(float)
    constant = float(y.mean()) if len(y) else 0.5
    net = train(np.stack(rows["pooled"].to_numpy()), y) if len(y) and 0 < constant < 1 else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is None or batch.num_rows == 0:
                scores = np.full(batch.num_rows, constant)
            else:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, _PARTS)
                scores = net.scores(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["id", "mark", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return table.mapInArrow(score, f"id {kind}, mark long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with their own columns; each row is judged by its own text."""
    scores = score_quality(docs, labels, id_col, text_col, **options)
    good = scores.filter(F.col("score") >= least).select(F.col(id_col).alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__mark"))
    return docs.join(good, same, "left_semi")
