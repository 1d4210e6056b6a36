"""Word vectors, pooling, network, sentences and noisy-or next to plain loops over words."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from fieldcal.llm import quality, toxicity
from fieldcal.llm.tokens import byte_values

MASK = (1 << 64) - 1
TEXTS = [
    "", "One", "one two  three, four!!", "Größe 12mm (x) \x00 y\n\nnext line", "a a a a b a a", "   ", "it's 3.14?No. YES\r\nlonger words here",
    " ".join(random.Random(1).choice(["alpha", "beta", "Gamma", "7", ";"]) for _ in range(400)), "....", "end",
]


def _block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _hash(word: bytes, values) -> int:
    total = sum(int(values[b]) * pow(0x9E3779B97F4A7C15 | 1, k, 1 << 64) for k, b in enumerate(word))
    return _mix(total + len(word) & MASK)


def _words(text: str) -> list[int]:
    values = byte_values(3, fold_case=False)
    found = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+", text.encode())
    return [_hash(w, values) % quality.BUCKETS for w in found]


def test_context_sums():
    wanted: dict[int, np.ndarray] = {}
    index = quality.index_vectors()
    for text in TEXTS:
        words = _words(text)
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    wanted[w] = wanted.get(w, 0) + index[words[j]].astype(float)
    total = np.zeros((quality.BUCKETS, quality.DIMS))
    quality._add_contexts(total, *quality._buckets(*_block(TEXTS)))
    for w, vector in wanted.items():
        assert total[w] == pytest.approx(vector)
    assert set(np.flatnonzero(total.any(axis=1))) <= set(wanted)


def test_pooled_vectors():
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    got = quality._pool_block(*_block(TEXTS), vectors)
    index = quality.index_vectors()
    for text, row in zip(TEXTS, got):
        words = _words(text)
        if not words:
            assert not row.any()
            continue
        own = np.mean([vectors[w] for w in words], axis=0)
        drawn = np.mean([index[w] for w in words], axis=0)
        alike = sum(float(index[a] @ index[b]) for a, b in zip(words, words[1:])) / len(words) / quality.NONZERO
        assert row == pytest.approx(np.array([*own, *drawn, alike, math.log1p(len(words)) / 8, math.sqrt(float(own @ own))]), abs=1e-4)


def test_network_output():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=3), np.array([1.0, 2.0, 0.5]), rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=2), 0.3, 1.7)
    x = rng.normal(size=(5, 3))
    for row, score in zip(x, net.scores(x)):
        z = [(row[i] - net.mean[i]) / net.scale[i] for i in range(3)]
        hidden = [math.tanh(sum(z[i] * net.w1[i, k] for i in range(3)) + net.b1[k]) for k in range(2)]
        logit = sum(hidden[k] * net.w2[k] for k in range(2)) + net.b2
        assert score == pytest.approx(1 / (1 + math.exp(-logit / 1.7)))


def _sentences(text: str):
    """(features, start, end) of each sentence that holds a word."""
    values, at = byte_values(5, fold_case=True), 0
    for part in re.split(rb"([\n\r.!?])", text.encode()):
        found = list(re.finditer(rb"[A-Za-z\x80-\xff]+", part))
        if found:
            words = [m.group() for m in found]
            features = {_hash(w, values) % toxicity.BUCKETS for w in words}
            for size in toxicity.BEGINNINGS:
                features |= {_mix(_hash(w[:size], values) + 1 & MASK) % toxicity.BUCKETS for w in words if len(w) > size}
            yield features, at + found[0].start(), at + found[-1].end()
        at += len(part)


def test_sentences_and_their_features():
    data, offsets = _block(TEXTS)
    bucket, sentence, doc, start, end = toxicity.sentence_words(data, offsets)
    got = [
        (int(doc[i]), set(bucket[sentence == i].tolist()), int(start[i] - offsets[doc[i]]), int(end[i] - offsets[doc[i]])) for i in range(len(doc))
    ]
    assert got == [(n, *s) for n, text in enumerate(TEXTS) for s in _sentences(text)]


def _loss(weights, bias, docs, labels):
    """Mean -log likelihood of document labels, with the pull of the weights towards zero."""
    total = toxicity.DECAY * sum(w * w for w in weights.values()) / 2
    for sentences, label in zip(docs, labels):
        clean = 1.0
        for features in sentences:
            clean *= 1 - 1 / (1 + math.exp(-(sum(weights.get(f, 0.0) for f in features) + bias)))
        total -= math.log(max(1e-300, 1 - clean if label else clean))
    return total / len(labels)


def test_noisy_or_is_trained_to_its_minimum():
    rng = random.Random(4)
    docs, labels = [], []
    for _ in range(200):
        sentences = [{rng.randrange(1, 9) for _ in range(3)} for _ in range(rng.randint(1, 4))]
        label = int(rng.random() < (0.9 if any(1 in s for s in sentences) else 0.1))
        docs.append(sentences), labels.append(label)
    flat = [(f, n) for n, s in enumerate(s for d in docs for s in d) for f in sorted(s)]
    bucket, sentence = (np.array(c) for c in zip(*flat))
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    weights, bias = toxicity.fit(bucket, sentence, doc, np.array(labels, float), rounds=3000)
    fitted = {f: float(weights[f]) for f in range(1, 9)}
    slopes = [(_loss(fitted, bias + 1e-5, docs, labels) - _loss(fitted, bias - 1e-5, docs, labels)) / 2e-5]
    for f in fitted:
        up, down = ({**fitted, f: fitted[f] + d} for d in (1e-5, -1e-5))
        slopes.append((_loss(up, bias, docs, labels) - _loss(down, bias, docs, labels)) / 2e-5)
    assert max(map(abs, slopes)) < 2e-3 and max(fitted, key=fitted.get) == 1
    model = toxicity.Model(weights, bias, 0.0)
    scores = model.documents(model.sentences(bucket, sentence, len(doc)), doc, len(docs))
    for sentences, score in zip(docs, scores):
        clean = math.prod(1 - 1 / (1 + math.exp(-(sum(fitted[f] for f in s) + bias))) for s in sentences)
        assert score == pytest.approx(1 - clean, abs=1e-9)
