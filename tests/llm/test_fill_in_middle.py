"""Fill-in-the-middle against a plain version, and back."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldcal.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, id string, n int, form string, output string, h0 long"


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)


def _rows():
    rng = random.Random(3)
    parts = ["word", "été", "😀😀", " ", "\n", "\t\x0b", "<", "<S", "S>", "<P", "M>", " ", "\x00", "\\1", "ÿ", "."]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " "), (403, "\n \n"), (404, "a<P>b"), (405, "<M>"), (406, "one"), (7, "again"), (7, "again"), (None, "no id at all")]
    return rows + [(500 + i, "lorem ipsum \n" * 30_000) for i in range(6)]


def test_against_brute_force(frame, monkeypatch):
    rows = _rows()
    for options in ({}, {"seed": 7, "rate": 100, "spm": 0}, {"seed": 8, "rate": 100, "spm": 100}):
        got = fim.fill_in_middle(frame(rows), **options).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain(*r, **options)) for r in rows)


def test_texts_come_back(frame):
    rows = _rows()
    for spm in (0, 50, 100):
        made = fim.fill_in_middle(frame(rows), rate=100, spm=spm)
        got = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, t or "")) for i, t in rows)


def test_empty_table(frame):
    out = fim.fill_in_middle(frame([]).limit(0))
    assert out.collect() == [] and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_units():
    values, parent, n = fim.units(pa.array([b" a  b ", b"", b"\n"], pa.binary()))
    assert values.to_pylist() == [b" a", b"  b", b" ", b"\n"] and parent.tolist() == [0, 0, 0, 2] and n.tolist() == [3, 0, 1]
