"""Columns named like an operator's own, ids that are missing or shared, and what stays in the shared folder."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldcal.llm.collocations import collocations
from fieldcal.llm.jaccard_join import jaccard_components, keep_one
from fieldcal.llm.line_dedup import line_dedup
from fieldcal.llm.mixing import copies, mixed
from fieldcal.llm.simhash import simhash_components

NAMES = "__row __lines __mark __n __copy __k1 __k2 __gone __id __salt row mark lines gone copy own n key size hash place id k1 pos h1".split()


@pytest.fixture(scope="module")
def frame(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in NAMES)
    return lambda rows: spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], schema)


def _words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))


ROWS = [(i, f"menu\n{_words(i, 30)}\n", f"s{i % 12}") for i in range(60)] + [(70, None, "s1"), (71, "", None), (None, "menu\nno id", "s2")]


@pytest.mark.parametrize("operator", [line_dedup, mixed, keep_one])
def test_columns_of_any_name_pass_through(frame, operator):
    docs = frame(ROWS)
    out = operator(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in rows)


def test_lines_of_documents_without_or_with_shared_ids(frame):
    none = [(None, f"menu\nown {i}", f"s{i}") for i in range(12)]
    texts = [r.text for r in line_dedup(frame(none)).collect()]
    assert sum("menu" in t for t in texts) == 1
    shared = [(1, f"menu\nown {i}", f"s{i}") for i in range(12)] + [(None, "menu", "s0")]
    texts = [r.text for r in line_dedup(frame(shared)).collect()]
    assert sum("menu" in t for t in texts) == 1 and "" in texts
    first = [(5, "menu\nx", f"s{i}") for i in range(12)] + [(4, "menu\ny", "s1")]
    assert sorted(r.text for r in line_dedup(frame(first)).collect()) == ["menu\ny"] + ["x"] * 12


def test_mixed_gives_the_copies_of_each_row(frame, monkeypatch):
    rows = [(i, _words(i, 5 + i % 3), f"s{i % 4}") for i in range(80)] + [(200, _words(0, 9), "s0")] * 50
    rows += [(200, _words(0, 9), "s3"), (None, _words(1, 6), "s2"), (None, _words(1, 6), "s2")]
    for hot in (2, 1024):
        monkeypatch.setattr("fieldcal.llm.mixing._HOT", hot)
        monkeypatch.setattr("fieldcal.llm.mixing._CHUNK", 7)
        docs = frame(rows)
        got: dict = {}
        for r in mixed(docs).collect():
            got[r.source] = got.get(r.source, 0) + len(r.text.split())
        placed = copies(docs.withColumnRenamed("source", "site"), source_col="site", carry=("site",))
        want = {r.site: r.taken for r in placed.groupBy("site").agg(F.sum("taken").alias("taken")).collect()}
        assert set(got) == {k for k, v in want.items() if v}
        assert all(abs(got.get(k, 0) - v) <= 3 * 9 for k, v in want.items())
        assert sorted(map(str, mixed(docs).collect())) == sorted(map(str, mixed(docs).collect()))


def test_words_that_collide_under_polynomials(frame):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, "s"), (2, other, "s"), (3, f"{word} x y", "s"), (4, f"{other} x y", "s"), (5, f"{other}\tX y", "s")]
    got = {r.id: r.component_id for r in jaccard_components(frame(rows), 3, 90, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_only_results_stay_in_the_shared_folder(spark, frame):
    rows = [(i, _words(i % 20, 40) + (" end" if i % 3 else ""), f"s{i % 5}") for i in range(80)]
    docs = frame(rows)
    cases = [
        (line_dedup, 1), (mixed, 1), (keep_one, 2), (jaccard_components, 1), (simhash_components, 2),
        (lambda d: collocations(d, least=2, lang_col="source"), 1),
    ]
    docs.count()
    line_dedup(docs)  # sets the folder
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    for operator, tables in cases:
        before = set(os.listdir(folder))
        out = operator(docs)
        left = set(os.listdir(folder)) - before
        assert len(left) == tables, (operator, left)
        assert out.count() > 0
