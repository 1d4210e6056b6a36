"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence has a probability from its different (hashed) features: words, and the beginnings of words of four and five
bytes, which inflected and compounded forms share. A document is toxic if one of its sentences
is, so its probability is the noisy-or 1 - prod(1 - p) over its sentences. The word weights are trained on document labels
through the noisy-or, on a bounded sample (``SAMPLE_ROWS`` documents of each label, chosen by hash of the id); the
sentence probabilities then say where a document offends. The score of a document is the noisy-or shifted by the
share of either label that the sample left out.

Sentences end at ``.``, ``!``, ``?`` or a line break. Words are runs of letters, A-Z lower-cased.

Defined results: null and empty texts, and texts without words, have no sentence and get the score of a document with
none; without labels of both kinds every score is the share of label 1 (0.5 without labels); rows repeated whole get the
same score; several labels of one id count as their largest; an empty table gives no rows.
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

#: Hashed features; labelled documents of each label that the weights may be trained on.
BUCKETS = 1 << 17
SAMPLE_ROWS = 2_000
ROUNDS = 250
#: Features in fewer documents of the sample have no weight.
LEAST_DOCUMENTS = 6
BEGINNINGS = (4, 5)
#: Pull of the weights towards zero, as documents.
DECAY = 0.1
#: A sentence of at least this probability is reported as offending.
OFFENDING = 0.5
_BREAK = 2


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    table[[0x0A, 0x0D, ord("."), ord("!"), ord("?")]] = _BREAK
    return table


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different features of each sentence: bucket and sentence of each; and each sentence's document, start and end byte."""
    classes = _classes()[data]
    start, end, doc = runs(classes, offsets)
    is_word = classes[start] == 1 if len(start) else np.zeros(0, bool)
    fresh = np.zeros(len(start), bool)
    if len(start):
        fresh[0] = True
        fresh[1:] = ~is_word[:-1] | (doc[1:] != doc[:-1])
    sentence = np.cumsum(fresh) - 1
    start, end, doc, sentence = start[is_word], end[is_word], doc[is_word], sentence[is_word]
    empty = np.zeros(0, np.int64)
    if not len(start):
        return empty, empty, empty, empty, empty
    sentence = np.cumsum(np.diff(sentence, prepend=sentence[0]) != 0)  # without those that hold no word
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    last = np.append(first[1:], len(sentence)) - 1
    prefix = prefix_hash(data, byte_values(5, fold_case=True))
    features = [sentence * BUCKETS + (span_hash(prefix, start, end) % np.uint64(BUCKETS)).astype(np.int64)]
    for size in BEGINNINGS:
        long = np.flatnonzero(end - start > size)
        hashed = mix(span_hash(prefix, start[long], start[long] + size) + np.uint64(1))
        features.append(sentence[long] * BUCKETS + (hashed % np.uint64(BUCKETS)).astype(np.int64))
    pair = np.unique(np.concatenate(features))
    return pair % BUCKETS, pair // BUCKETS, doc[first], start[first], end[last]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, shift: float):
        self.weights, self.bias, self.shift = weights, bias, shift

    def sentences(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Log of the probability that each sentence is clean."""
        z = np.bincount(sentence, self.weights[bucket], n) + self.bias
        return -np.logaddexp(0, z)

    def documents(self, clean: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of each document, moved to the true share of labels."""
        total = np.bincount(doc, clean, n)
        log_toxic = np.log(np.maximum(-np.expm1(total), 1e-12))
        return 1 / (1 + np.exp(-np.clip(log_toxic - total + self.shift, -40, 40)))


def fit(bucket: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of document labels under the noisy-or (Adam, all rows a step).

    ``doc`` is the document of each sentence.
    """
    n_docs, n_sentences = len(y), len(doc)
    # Words start at the log-odds of the documents that hold them.
    pair = np.unique(doc[sentence] * BUCKETS + bucket)
    held, label = pair % BUCKETS, y[pair // BUCKETS]
    toxic = np.bincount(held, label, BUCKETS) + 0.5
    clean = np.bincount(held, 1 - label, BUCKETS) + 0.5
    odds = np.log(toxic / clean) - np.log(y.sum() / (n_docs - y.sum()))
    used = toxic + clean - 1 >= LEAST_DOCUMENTS
    weights, bias = np.where(used, np.clip(odds, -1, 3) * 0.5, 0.0), -6.0
    real = used[bucket]
    bucket, sentence = bucket[real], sentence[real]
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weights[bucket], n_sentences) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(doc, -np.logaddexp(0, z), n_docs)
        whole = np.maximum(-np.expm1(total), 1e-9)
        # d(-log likelihood)/dz = p for a clean document, -p (1 - P) / P for a toxic one
        slope = np.where(y[doc] > 0, -p * np.exp(total[doc]) / whole[doc], p) / n_docs
        g = np.bincount(bucket, slope[sentence], BUCKETS)
        g[used] += DECAY * weights[used] / n_docs
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15 * (1 - 0.8 * t / rounds)
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return weights, float(bias)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text → label, sentence ends (number of words so far) and words of each document."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            bucket, sentence, doc, _, _ = sentence_words(data, offsets)
            per_sentence = np.bincount(sentence, minlength=len(doc)) if len(doc) else np.zeros(0, np.int64)
            n = b - a
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, n),
                    list_array(per_sentence, np.bincount(doc, minlength=n), pa.int32()),
                    list_array(bucket, np.bincount(doc[sentence], minlength=n) if len(doc) else np.zeros(n, int), pa.int32()),
                ],
                ["label", "lengths", "words"],
            )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    learn_from: Column | None = None, sample_rows: int = SAMPLE_ROWS,
) -> Model | float:
    """A model, or the share of label 1 where there are not both labels."""
    known = labels if learn_from is None else labels.filter(learn_from)
    known = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label"))
    known = known.filter("__id is not null and label is not null").groupBy("__id").agg((F.max("label") > 0).cast("int").alias("label"))
    known = stored(known, "labels")
    share = known.agg(F.avg("label")).first()[0]
    pick = [known.filter(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows) for c in (0, 1)]
    chosen = stored(pick[0].unionAll(pick[1]), "sample")
    texts = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))  # at most 2 * sample_rows ids
    texts = texts.select("label", F.col(text_col).alias("__text"), "__id")
    words = texts.select("label", "__text").mapInArrow(_words_of, "label int, lengths array<int>, words array<int>")
    rows = words.limit(4 * sample_rows).toPandas()
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return 0.5 if share is None else float(share)
    lengths = np.concatenate([*rows["lengths"]]).astype(np.int64)
    bucket = np.concatenate([*rows["words"]]).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), [len(x) for x in rows["lengths"]])
    del rows
    if not len(bucket):
        return float(share)
    weights, bias = fit(bucket, np.repeat(np.arange(len(lengths)), lengths), doc, y)
    sampled = y.mean()
    shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)) if 0 < share < 1 else 0.0
    return Model(weights, bias, float(shift))


def _score(docs: DataFrame, model: Model | float, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    fixed = isinstance(model, float)
    empty = Model(np.zeros(BUCKETS), -40.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(empty if fixed else model)  # BUCKETS weights, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                bucket, sentence, doc, start, end = sentence_words(data, offsets)
                clean = shared.value.sentences(bucket, sentence, len(doc))
                scores = np.full(b - a, model) if fixed else shared.value.documents(clean, doc, b - a)
                yield make(batch.column(0).slice(a, b - a), scores, -np.expm1(clean), doc, start - offsets[doc], end - offsets[doc])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def score_toxicity(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, and where it offends: spans array<struct<start, end, score>> in bytes of the UTF-8 text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def make(ids, scores, p, doc, start, end):
        bad = np.flatnonzero(p >= OFFENDING)
        values = pa.StructArray.from_arrays([pa.array(start[bad]), pa.array(end[bad]), pa.array(p[bad])], ["start", "end", "score"])
        at = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.bincount(doc[bad], minlength=len(ids)), out=at[1:])
        spans = pa.ListArray.from_arrays(pa.array(at), values.cast(span))
        return pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64()), spans], ["id", "score", "spans"])

    return _score(
        docs, model, id_col, text_col, make, "score double, spans array<struct<start: bigint, end: bigint, score: double>>"
    )
