"""SimHash fingerprints and their components against plain versions."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldcal.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, id string, fp string, first int, own int, key int"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text, n):
    words = brute.WORD.findall((text or "").encode().translate(_LOWER))
    shingles = [words[i : i + n] for i in range(len(words) - n + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], bits: int) -> list[int]:
    """Smallest index reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(prints)):
        for i in range(j):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA)


def _rows():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One\tTWO "), (5, "été 東京 x y z"), (6, "end"), (7, " lead and trail ")]
    for g in range(25):
        words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(rng.choice([5, 300]))]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            if rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), "long text of one document " * 20_000)]


def test_against_brute_force(frame, monkeypatch):
    rows = _rows()
    for n, chunk in ((3, 7), (5, simhash._CHUNK)):
        monkeypatch.setattr(simhash, "_CHUNK", chunk)
        got = {r.id: r for r in simhash.simhash_components(frame(rows), n, 2).withColumn("hex", simhash.hex_digits(F.col("fp"))).collect()}
        prints = [fingerprint(t, n) for _, t in rows]
        assert [got[i].hex for i, _ in rows] == [f"{p:016x}" for p in prints]
        assert [got[i].component_id for i, _ in rows] == groups(prints, 2)


@pytest.mark.parametrize("bits,bucket", [(2, 64), (2, 1), (2, 4), (4, 1), (4, 64)])
def test_links_of_near_fingerprints(spark, monkeypatch, bits, bucket):
    """Chains and dense groups of fingerprints; small buckets send all of them through single bits."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bits * 100 + bucket)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for b in rng.sample(range(64), rng.randint(1, bits + 1)):
                at ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.close_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()
    place = {s: i for i, s in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= bits
        a, b = sorted((find(place[r.a]), find(place[r.b])))
        root[b] = a
    assert [find(i) for i in range(len(prints))] == groups(prints, bits)


def test_rows_that_share_an_id_or_have_none(frame):
    rows = [(9, "a b c d"), (9, "other words in here"), (2, "other words in here"), (None, "a b c d"), (None, "nowhere else to be seen"), (5, "a b c d")] + [(3, "")] * 300
    got = [(r.id, r.component_id) for r in simhash.simhash_components(frame(rows), 3).collect()]
    want = [(9, 5), (9, 2), (2, 2), (None, 5), (None, None), (5, 5)] + [(3, 3)] * 300
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_table_and_parameters(frame):
    assert simhash.simhash_components(frame([]).limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_components(frame([(1, "a")]), bits=3)
