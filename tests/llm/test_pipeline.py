"""The pipeline stage by stage against plain versions, each on its own input."""

from __future__ import annotations

import base64
import pathlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from fieldcal.llm.line_dedup import MIN_SITES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def outputs(spark):
    """Input and output rows of every stage."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found.append((name, docs, docs.collect(), out, out.collect()))
        docs = corpus_pipeline.saved(out, "stage")
    return found


def test_columns(outputs):
    for _, docs, _, out, _ in outputs[:-1]:
        assert out.columns == docs.columns


def test_rejected_documents_go_and_good_ones_stay(spark, outputs):
    _, _, before, _, after = outputs[0]
    quality = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if quality.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if quality.get(r.doc_id) == 0]
    assert sum(d in kept for d in good) >= 0.99 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)
    rows = {r.doc_id: r for r in before}
    assert all(r == rows[r.doc_id] for r in after)


def test_lines(outputs):
    _, _, before, _, after = outputs[1]
    sites: dict = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        for i, line in enumerate((r.text or "").split("\n")):
            sites.setdefault(line.strip(" "), [(r.doc_id, i), set()])[1].add(r.source)
    common = {line: first for line, (first, held) in sites.items() if line and len(held - {None}) >= MIN_SITES}
    got = {r.doc_id: r for r in after}
    assert len(got) == len(before)
    for r in before:
        lines = [x for i, x in enumerate(r.text.split("\n")) if common.get(x.strip(" "), (r.doc_id, i)) == (r.doc_id, i)]
        assert got[r.doc_id].text == "\n".join(lines) and got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_near_copies(outputs):
    _, _, before, _, after = outputs[2]
    want = brute.jaccard_components({r.doc_id: r.text for r in before}, corpus_pipeline.SHINGLE_WORDS, *corpus_pipeline.SIMILARITY)
    assert {r.doc_id for r in after} == {label for _, label in want.values()} and len(after) == len({r.doc_id for r in after})


def test_mixing_and_encoding(outputs):
    _, _, before, _, after = outputs[3]
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in before}
    words = sum(len(brute.WORD.findall((r.text or "").encode())) for r in before)
    taken = sum(len(brute.WORD.findall((r.text or "").encode())) for r in after)
    assert abs(taken - words) <= 0.1 * words
    _, _, texts, _, coded = outputs[4]
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in texts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded) == want and all(r.round_trip for r in coded)


def test_run_gives_the_same_rows(spark, outputs):
    ids = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    assert ids == Counter((r.doc_id, r.n_tokens) for r in outputs[-1][4])
