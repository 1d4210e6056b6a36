"""Phrase mining against a plain version, and the guarantee of its summaries."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldcal.llm import collocations as mining
from fieldcal.llm.tokens import word_hash

SCHEMA = "doc_id long, text string, lang string, phrase string, words int, n string, key int"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, share=50, top=2000):
    grams, words = {}, Counter()
    for text, lang in rows:
        count = grams.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in grams.items():
        found = {p: f for p, f in count.items() if len(p) > 1 and f >= least}
        rest = []
        for p, a in found.items():
            inside = (
                len(o) > len(p) and 100 * f >= share * a and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1)) for o, f in found.items()
            )
            if not any(inside):
                score, _, l, r = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rest.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(rest)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)

    return make


def _texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "new", "york", "CITY", "a", "été", "😀", "san", "x" * 70, "Long" * 40]
    join = [" ", "\t", "  ", ", ", ". ", "\n", " "]
    rows = [("".join(w + rng.choice(join) for w in rng.choices(vocabulary, k=rng.randint(0, 80))), rng.choice(["en", "de", None])) for _ in range(n)]
    rows += [("new york city hall " * 30, "en"), ("a " * 200, "fr"), (None, "en"), ("", None), (" .,\n", "es"), ("one two", "es")]
    return rows + rows[:3]


def test_against_brute_force(frame):
    rows = _texts(1)
    assert rows_of(mining.collocations(frame(rows))) == plain(rows)
    got = mining.collocations(frame(rows), longest=4, least=3, share=80, top=5)
    assert rows_of(got) == plain(rows, 4, 3, 80, 5)


def test_many_small_partitions_and_summaries(frame, monkeypatch):
    monkeypatch.setattr(mining, "MASS", 200)
    monkeypatch.setattr(mining, "_FLUSH", 50)
    monkeypatch.setattr(mining, "_PHRASES", 20)
    monkeypatch.setattr(mining, "MOST_BITS", 10)  # so full that nearly everything comes through
    rows = _texts(2)
    assert rows_of(mining.collocations(frame(rows))) == plain(rows)


def test_edge_rows(frame):
    assert mining.collocations(frame([]).limit(0)).collect() == []
    assert mining.collocations(frame([(None, None), ("", "en")])).collect() == []
    long = [("salt and pepper " * 20_000, "en")]
    assert rows_of(mining.collocations(frame(long))) == plain(long)


def test_products_of_more_than_64_bits(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 9_000_000_011
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(mining._score(df.a, df.l, df.r)).first()[0] == mining.SCALE * a * a // (left * right)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=6), st.integers(2, 12), st.integers(1, 8))
def test_every_frequent_key_survives(streams, least, capacity):
    summary, total = mining.Summary(capacity, least), Counter()
    for stream in streams:
        total.update(stream)
        keys, counts = np.unique(np.array(stream, np.uint32), return_counts=True)
        summary.add(keys, counts.astype(np.int64))
    kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert summary.taken < least
    assert all(total[k] - summary.taken <= kept.get(k, 0) <= total[k] for k in total)
    assert {k for k, f in total.items() if f >= least} <= set(summary.survivors().tolist())


def test_summaries_take_from_counters():
    summary = mining.Summary(10, 10)
    summary.add(np.arange(100, dtype=np.uint32), np.append(np.full(5, 20), np.ones(95)).astype(np.int64))
    assert summary.taken == 1 and len(summary.keys) == 5


def test_word_hash_has_no_algebraic_collisions():
    """Thue-Morse words and their complements collide under every polynomial modulo 2 ** 64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba"))).encode(), np.uint8)
        n = len(word)
        x, y = word_hash(data, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y
    data = np.frombuffer(b"abcdefgh" * 30, np.uint8)
    ends = np.arange(1, 241)
    assert len(set(word_hash(data, np.zeros(240, np.int64), ends).tolist())) == 240
    assert word_hash(data, np.array([0]), np.array([9]))[0] == word_hash(data, np.array([16]), np.array([25]))[0]
