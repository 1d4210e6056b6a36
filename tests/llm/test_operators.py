"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldcal.llm import bpe as bpe_module
from fieldcal.llm import exact_dedup as exact_dedup_module
from fieldcal.llm import jaccard_join, quality, substring_dedup, topk_search, toxicity, warc
from fieldcal.llm.catalog import VOCABULARY
from fieldcal.llm.exact_dedup import directory, exact_dedup
from fieldcal.llm.line_dedup import line_dedup
from fieldcal.llm.mixing import copies, mixed
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, h long, id string, size int, n int"


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        """(doc_id, text, source) with columns whose names the operators use inside."""
        return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)

    return make


def _prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


LONG = _prose(0, 60_000)
ROWS = [
    (1, _prose(1, 80), "a"), (2, _prose(1, 80), "b"), (3, None, "a"), (4, "", None), (5, "x", "c"), (6, LONG, "a"),
    (7, _prose(1, 80).replace("a", "b", 1), "c"), (8, _prose(8, 50) + " " + _prose(1, 40), "b"), (8, _prose(9, 30), "b"),
    (9, _prose(9, 30), None), (9, _prose(9, 30), None), (None, "no id", "a"), (10, "Été ßß 東京 😀", "a"),
]


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup(frame):
    got = exact_dedup(frame(ROWS), capacity=1).collect()
    assert len(got) == len(ROWS)
    texts = [t or "" for _, t, _ in ROWS]
    for r in got:
        same = [(i, t) for (i, _, _), t in zip(ROWS, texts) if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((i for i, _ in same if i is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_empty(frame):
    assert exact_dedup(frame(ROWS).limit(0)).collect() == []


def test_rows_come_out_of_the_index(frame, monkeypatch):
    found = exact_dedup_module.directory

    def lost(keys, capacity):
        slots, bits = found(keys, capacity)
        return slots.filter("bucket % 2 = 0"), bits

    monkeypatch.setattr(exact_dedup_module, "directory", lost)
    got = exact_dedup(frame(ROWS), capacity=1).count()
    assert 0 < got < len(ROWS)  # buckets that the directory lacks give no rows


def test_two_texts_of_one_hash_are_two_nodes(frame, monkeypatch):
    monkeypatch.setattr(exact_dedup_module.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    texts = ["a", "b", "a", None, "", "c"]
    got = exact_dedup(frame([(i, t, "s") for i, t in enumerate(texts)]), capacity=8).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {
        0: (2, 2, False), 1: (1, 1, True), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True),
    }


def test_hashes_that_share_sixty_bits_stay_in_the_directory(spark):
    keys = spark.createDataFrame([(5,), (6,), (7,), (-1,)], "h long")
    slots, bits = directory(keys, 1)
    assert bits == 60 and sorted(r.slot for r in slots.collect()) == [0, 2**60 - 1]


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    slots, bits = directory(keys, 100)
    buckets = {r.bucket for r in slots.collect()}
    placed = keys.withColumn("slot", F.shiftrightunsigned("h", 64 - bits)).join(slots, "slot")
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 100 and len(buckets) == len(sizes)


# ---------------------------------------------------------------- mixing


def test_mixing(frame):
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(300)] + [(300, None, None), (301, "one two", None)]
    got = copies(frame(rows)).collect()
    total = sum(r.size for r in got)
    by_source: dict = {}
    for r in got:
        by_source.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.n_copies * r.size
    assert len(got) == len(rows) and sum(t for _, t in by_source) == pytest.approx(total)
    for (size, target), members in by_source.items():
        assert target <= 3 * size + 1e-9 and abs(sum(r.taken for r in members) - target) <= 3 * max(r.size for r in members)
    again = {r.doc_id: r.taken for r in copies(frame(rows)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixed(frame(rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    taken: dict = {}
    sizes = {r.doc_id: r for r in got}
    for r in out.collect():
        taken[sizes[r.doc_id].source_size] = taken.get(sizes[r.doc_id].source_size, 0) + sizes[r.doc_id].size
    for (size, target), members in by_source.items():
        assert abs(taken.get(size, 0) - target) <= 3 * max(r.size for r in members)


def test_mixing_of_rows_repeated_whole(frame):
    """Each of them gets the copies of its own place, as in ``copies``, not those of the luckiest."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a")] * 300 + [(2, text, "c")] * 300 + [(3, text, "b")] * 100 + [(10 + i, text, "b") for i in range(200)]
    rows += [(4, text, None)] * 7
    frames = frame(rows)
    want: dict = {}
    for r in copies(frames).withColumnRenamed("doc_id", "d").collect():
        source = {1: "a", 2: "c", 4: None}.get(r.d, "b")
        want[source] = want.get(source, 0) + r.n_copies
    got: dict = {}
    for r in mixed(frames).collect():
        got[r.source] = got.get(r.source, 0) + 1
    assert got == want and 2 * got["a"] < 320 and got["c"] < 480


def test_mixing_all_rows_and_empty(frame):
    assert mixed(frame(ROWS)).count() > 0
    assert copies(frame(ROWS).limit(0)).collect() == []
    assert {r.taken for r in copies(frame([(1, None, "a"), (2, "", "b")])).collect()} == {0}


# ---------------------------------------------------------------- line dedup


def test_line_dedup(frame):
    rows = [(i, f"own {i}\n  shared line \n\nlast {i}", f"s{i}") for i in range(6)]
    rows += [(6, "shared line", None), (7, None, "s1"), (8, "", "s2"), (9, "twice\ntwice", "s3"), (None, "shared line\nx", "s9")]
    got = {r.doc_id: r for r in line_dedup(frame(rows), min_sites=5, counts=("lines", "gone")).collect()}
    assert got[0].text == rows[0][1] and got[0].gone == 0  # the first occurrence stays
    assert got[3].text == "own 3\n\nlast 3" and (got[3].lines, got[3].gone) == (4, 1)
    assert got[6].text == "" and got[7].text is None and got[8].text == "" and got[9].text == "twice\ntwice"
    assert got[None].text == "x"
    assert line_dedup(frame(rows)).columns == frame(rows).columns
    assert line_dedup(frame(rows).limit(0)).collect() == []
    assert {r.gone for r in line_dedup(frame(rows), min_sites=8, counts=("lines", "gone")).collect()} == {0}


# ---------------------------------------------------------------- top-k


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12)).astype("float32")
    vectors[100:160] = vectors[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(700, None), (800, [float("nan")] * 12), (900, [None] * 12), (None, [1.0] * 12), (1000, [0.5, float("inf")]), (1100, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("v"))
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, k=10, shard_rows=150, block_rows=3).collect()
    valid = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in rows[:700]} | {1100: np.zeros(12, np.int64)}
    want = []
    for q in (i for i in valid if i % 100 == 0):
        scored = sorted((-int(valid[q] @ v), i) for i, v in valid.items() if i != q)[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_index_stops_before_the_end():
    rng = np.random.default_rng(1)
    vectors = np.floor(1024 * rng.normal(size=(3000, 4))).astype(np.int64)
    index = topk_search.ImpactIndex(np.arange(3000), vectors)
    for q in range(20):
        ids, scores = index.search(vectors[q], q, 5, rescore=200)
        want = sorted((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q)[:5]
        assert [(-s, i) for i, s in zip(ids, scores)] == want


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_rows(frame, library):
    rows = [*ROWS, (20, "a" * 20_000, "a"), (21, "don't 'tis 's''re  x\n\n y \t", "a"), (22, " ", "a")]
    got = bpe_module.bpe(frame(rows), VOCABULARY, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        pieces = [library.decode_single_token_bytes(i) for i in r.ids]
        assert r.offsets == [sum(map(len, pieces[:k])) for k in range(len(pieces))] if len(pieces) < 500 else True
    assert bpe_module.bpe(frame(rows).limit(0), VOCABULARY).collect() == []


def test_bpe_pieces_by_chance(library):
    rng = random.Random(5)
    letters = [*"aste'''  \n\t!?9rvldm'LS", "é", "ß", "中", "😀", " ", " ", "́", "½", "'re", "'ll", "  "]
    tool = bpe_module.codec(VOCABULARY)
    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        ids, counts = tool.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [library.encode_ordinary(t) for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_bpe_merges_distinct_pieces_together(library, monkeypatch):
    """A corpus of ever new words costs no Python loop for each: only lengths of few pieces, and long ones, go one by one."""
    rng = random.Random(6)
    longest = ["".join(rng.choices("abé中", k=400)) for _ in range(3)]
    texts = [" ".join("".join(rng.choices("abcdestéß中", k=rng.randint(1, 60))) for _ in range(400)) for _ in range(20)] + longest
    alone = []

    def merge(piece, ranks, plain=bpe_module.merge):
        alone.append(piece)
        return plain(piece, ranks)

    monkeypatch.setattr(bpe_module, "merge", merge)
    raw = [t.encode() for t in texts]
    ids, counts = bpe_module.Codec(VOCABULARY).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [library.encode_ordinary(t) for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert {t.encode() for t in longest} <= set(alone) and len(alone) < 300


def test_bpe_with_ranks_in_any_order(tmp_path):
    """Tokens that merging does not reach, and merges that make a token of lower rank than their own parts."""
    rng = random.Random(7)
    for n in range(10):
        tokens = {bytes([b]) for b in range(256)} | {"".join(rng.choices("abcd ", k=rng.randint(2, 6))).encode() for _ in range(n * 15)}
        order = rng.sample(sorted(tokens), len(tokens))
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(order)))
        ranks = {t: k for k, t in enumerate(order)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        raw = " ".join("".join(rng.choices("abcd", k=rng.randint(1, rng.choice([4, 20, 90])))) for _ in range(300)).encode()
        ids, _ = bpe_module.Codec(str(path)).encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == own.encode_ordinary(raw.decode())


# ---------------------------------------------------------------- suffix dedup


def test_substring_dedup_against_brute_force(frame):
    base = _prose(31, 400)
    docs = {i: t for i, t, _ in ROWS if i is not None and i not in (8, 9)} | {
        20: base, 21: base, 22: base[:700] + " other " + base[650:], 23: "ab" * 300, 24: "ab" * 90 + "c", 25: base[100:199],
        26: base[100:200], 27: "é" * 120, 28: _prose(5, 10) + base[300:420], 29: base[::-1] + base[::-1],
    }
    got = substring_dedup.substring_dedup(frame([(k, v, "a") for k, v in docs.items()])).collect()
    want = brute.repeated_bytes(docs, 100)
    for r in got:
        removed = sum(s.end - s.start for s in r.spans)
        assert (r.n_bytes, removed, len(r.spans), bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert len(got) == len(docs)


def test_substring_dedup_edge_rows(frame):
    got = substring_dedup.substring_dedup(frame(ROWS))
    assert got.count() == len(ROWS) and got.filter("doc_id is null").count() == 1
    assert substring_dedup.substring_dedup(frame(ROWS).limit(0)).collect() == []


def test_substring_dedup_of_long_strings(frame):
    """Stretches of more than 1,023 windows."""
    base = _prose(61, 1500)
    docs = {1: base, 2: _prose(62, 300) + base[500:5000], 3: base[:1999], 4: base[1000:3000] + _prose(63, 50)}
    got = substring_dedup.substring_dedup(frame([(k, v, "a") for k, v in docs.items()]), length=2000).collect()
    want = brute.repeated_bytes(docs, 2000)
    assert {r.doc_id: bytes(r.kept) for r in got} == {k: bytes(w[3]) for k, w in want.items()}
    for length, seed in ((49, 50 + 1), (50_000, 50), (100, 0)):
        with pytest.raises(ValueError):
            substring_dedup.substring_dedup(frame(ROWS), length, seed)


# ---------------------------------------------------------------- Jaccard join


def test_jaccard_against_brute_force(frame):
    rng = random.Random(7)
    docs: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "one two", 4: "One TWO", 5: LONG, 6: LONG + " end"}
    for g in range(12):
        words = _prose(100 + g, 120).split()
        for c in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit"
            docs[len(docs)] = " ".join(copy)
    common = _prose(999, 30)
    for i in range(20):
        docs[len(docs)] = common + " " + _prose(2000 + i, rng.randint(1, 40))
    for n, num, den in ((3, 90, 100), (5, 80, 100)):
        got = jaccard_join.jaccard_components(frame([(k, v, "a") for k, v in docs.items()]), n, num, den).collect()
        want = brute.jaccard_components(docs, n, num, den)
        assert {r.id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs)


def test_jaccard_edge_rows(frame):
    assert jaccard_join.jaccard_components(frame(ROWS)).count() == len(ROWS)
    assert jaccard_join.jaccard_components(frame(ROWS).limit(0)).collect() == []
    kept = jaccard_join.keep_one(frame(ROWS))
    assert kept.columns == frame(ROWS).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _ in ROWS if i not in (2, 7, 9))


def test_keep_one_where_ids_are_not_unique(frame):
    near, other, alone = _prose(50, 90), _prose(51, 60), _prose(52, 70)
    rows = [(3, near, "a"), (7, near + " end", "a"), (7, other, "b")]  # only the first text of id 7 is a near copy
    rows += [(20, alone, "c")] * 40 + [(21, alone + " end", "c")] * 30  # rows repeated whole are one document
    rows += [(30, near[::-1], "d")] * 5  # without any other text
    rows += [(40, "", "e"), (40, "", "e"), (None, near, "f"), (None, near, "f")]  # no words or no id: all stay
    kept = sorted((str(r.doc_id), r.text, r.source) for r in jaccard_join.keep_one(frame(rows)).collect())
    want = [rows[0], rows[2], (20, alone, "c"), (30, near[::-1], "d"), *rows[-4:]]
    assert kept == sorted((str(i), t, s) for i, t, s in want)


# ---------------------------------------------------------------- classifiers


def _labelled(spark, frame, toxic: bool):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        words, bad = _prose(500 + i, 40).split(), i % 4 == 0
        if bad and toxic:
            words[rng.randrange(40)] = "scoundrel"
        elif bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]), "a"))
        labels.append((i, int(bad == toxic)))
    rows += [(400, None, "a"), (401, "", "a"), (401, "", "a"), (None, "no id", "a")]
    return frame(rows), spark.createDataFrame(labels, "doc_id long, y int")


def test_quality(spark, frame):
    docs, labels = _labelled(spark, frame, toxic=False)
    known = dict(map(tuple, labels.collect()))
    got = quality.score_quality(docs, labels, label_col="y", learn_from=F.col("doc_id") % 5 != 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5) == (known[r.doc_id] == 1) for r in got if r.doc_id in known and r.doc_id % 5 == 0]
    assert np.mean(held) > 0.95
    none = quality.score_quality(docs, labels.limit(0), label_col="y").collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(docs.limit(0), labels, label_col="y").collect() == []
    kept = quality.keep_good(docs, labels, 0.3, label_col="y")
    assert kept.columns == docs.columns and 290 <= kept.count() <= 310


def test_toxicity_finds_sentences(spark, frame):
    docs, labels = _labelled(spark, frame, toxic=True)
    known = dict(map(tuple, labels.collect()))
    model = toxicity.train(docs, labels, label_col="y", learn_from=F.col("doc_id") % 5 != 0)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [r for r in got if r.doc_id in known and r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.3) == (known[r.doc_id] == 1) for r in held]) > 0.95
    for r in held:
        if known[r.doc_id] and r.spans:
            assert any("scoundrel" in texts[r.doc_id].encode()[s.start : s.end].decode() for s in r.spans)
    assert toxicity.train(docs, labels.limit(0), label_col="y") == 0.5
    assert toxicity.score_toxicity(docs.limit(0), 0.5).collect() == []
    assert {r.score for r in toxicity.score_toxicity(docs, 0.25).collect()} == {0.25}


def test_noisy_or():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, 0.0)
    clean = np.log([0.5, 0.5, 0.9])
    assert model.documents(clean, np.array([0, 0, 2]), 3) == pytest.approx([0.75, 0.0, 0.1], abs=1e-9)


# ---------------------------------------------------------------- WARC


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark):
    pages = {
        1: "<p>plain</p>", 2: "x" * 5000 + "é" * 3000, 3: "", 4: None, 5: "<p>plain</p>", 6: "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9,
        7: "a\r\n0\r\n\r\nb", 8: "東京" * 2000, 9: "WARC/1.1", 10: "WARC" * 700 + "/1.1" * 700,
    }
    df = spark.createDataFrame([(k, f"http://h/{k} \r\nWARC/1.1", v, "t") for k, v in pages.items()], "page_id long, url string, html string, record string")
    got = warc.warc_round_trip(df, with_payload=True, chunk_chars=700, segment_chars=1500).collect()
    assert sorted(r.page_id for r in got) == list(pages) and all(r.error is None for r in got)
    first = {v or "": min(k for k, x in pages.items() if (x or "") == (v or "")) for v in pages.values()}
    for r in got:
        data = (pages[r.page_id] or "").encode()
        origin = first[data.decode()]
        assert (r.payload_bytes, r.payload_digest) == (len(data), _digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if origin == r.page_id else ("revisit", origin))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_warc_reports_broken_records(spark, tmp_path):
    def record(kind, rid, body, *more):
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(body)}"]
        return "\r\n".join(head) + "\r\n\r\n" + body + "\r\n\r\n"

    http = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    whole = http + "5\r\nhello\r\n0\r\n\r\n"
    text = (
        record("response", "<urn:page:1:a>", whole)
        + record("response", "<urn:page:2:a>", http + "9\r\nhello\r\n0\r\n\r\n")
        + record("response", "<urn:page:3:a>", whole[:30], "WARC-Segment-Number: 1")
        + record("continuation", "<x>", whole[40:], "WARC-Segment-Origin-ID: <urn:page:3:a>", "WARC-Segment-Number: 3", f"WARC-Segment-Total-Length: {len(whole)}")
        + record("response", "<urn:page:4:a>", whole[:30], "WARC-Segment-Number: 1")
        + record("continuation", "<y>", whole[30:], "WARC-Segment-Origin-ID: <urn:page:4:a>", "WARC-Segment-Number: 2", f"WARC-Segment-Total-Length: {len(whole)}")
        + record("response", "<urn:page:5:a>", "HTTP/1.1 200 OK\r\n\r\nplain")
        + record("warcinfo", "<z>", "about")
    )
    (tmp_path / "one.warc").write_bytes(text.encode())
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert bytes(got[1].payload) == bytes(got[4].payload) == b"hello" and bytes(got[5].payload) == b"plain"
    assert "framing" in got[2].error and got[3].error == "a segment is missing"
