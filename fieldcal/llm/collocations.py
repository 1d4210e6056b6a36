"""Phrases whose words stand together more often than their parts would by themselves.

A text, A-Z lower-cased, is cut at sentence marks into pieces and those into words; an n-gram is a row of words inside a
piece. A phrase of two or more words with at least ``least`` occurrences in its language is a candidate, with the score
``SCALE * a * a / (l * r)`` of its weakest cut into two parts (a, l, r: occurrences of phrase and parts).

Which n-grams are that frequent is found in two passes over the texts, without a table of all n-grams:

1. N-grams are dealt by hash into partitions of about ``MASS`` occurrences each. A task adds up its own n-grams and sends each
   partition its (hash, count) pairs; the partition adds them to a Misra-Gries summary: when it holds more counters than its
   capacity, ``HEADROOM`` times mass over threshold, the count of the first one beyond is taken from all, and counters that
   reach zero go. What was taken is added up, and it stays below the threshold (rather than exceed it, a
   partition doubles its capacity), so every n-gram of ``least`` or more occurrences survives.
2. The survivors set bits in a table of at most ``2 ** MOST_BITS`` bits, which all tasks get. N-grams that are not in it are not
   frequent; the others are counted exactly, by their words: each task adds up its own and sends each partition its phrases
   and counts, which are added there. N-grams that came through by chance have too small a count, and go. A fuller table
   costs time, not results.

Defined results: null and empty texts have no words; a null language is ``und``; rows that share an id or are repeated whole
count each; phrases of equal score and count are ordered by their UTF-8 bytes; an empty table gives no rows; other columns are
ignored, whatever their names. Inside a task n-grams are told apart by 64 bits of hash, between tasks by their words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.scratch import saved
from fieldcal.llm.tokens import fold_case, mix, one_blank, runs, text_blocks, word_hash
from fieldcal.operators.ordering import with_positions
from fieldcal.session import scratch_scope

#: Occurrences of n-grams for each hash partition, and counters of its summary in units of mass over threshold.
MASS = 1 << 22
HEADROOM = 2
#: log2 of the bits of the survivors' table at most, and bits for each survivor.
MOST_BITS = 27
_BITS_EACH = 32
#: Entries that a task adds up before it sends them on.
_FLUSH = 1 << 22
_PHRASES = 1 << 19
SCALE = 1_000_000
_WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """1 for bytes of words; True for bytes between pieces."""
    cut = np.zeros(256, bool)
    cut[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    word = np.where(cut, 0, 1).astype(np.uint8)
    word[[0x20, 0x09]] = 0
    return word, cut


_IS_WORD, _IS_CUT = _byte_classes()


class _Block:
    """Words of a block of texts, and the hash of every n-gram of 1 to ``longest`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], longest: int):
        self.data, self.langs = fold_case()[data], np.array([*langs, ""], object)[:-1]
        self.start, self.end, self.doc = runs(_IS_WORD[data], offsets)
        names = [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in langs]
        words = word_hash(self.data, self.start, self.end, 17)
        at, hashes, size = [], [], []
        if len(words):
            piece = np.cumsum(_IS_CUT[data], dtype=np.int64)[self.start]
            new = np.ones(len(words), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
            piece = np.cumsum(new)
            h = mix(np.array(names, np.uint64)[self.doc])
            for k in range(1, longest + 1):
                n = len(words) - k + 1
                if n <= 0:
                    break
                h = mix(h[:n] * _ODD + words[k - 1 :])
                whole = np.flatnonzero(piece[:n] == piece[k - 1 :])
                at.append(whole)
                hashes.append(h[whole])
                size.append(np.full(len(whole), k, np.int8))
        none = np.zeros(0, np.int64)
        self.at = np.concatenate([none, *at])
        self.hashes = np.concatenate([none.astype(np.uint64), *hashes])
        self.size = np.concatenate([none.astype(np.int8), *size])

    def phrases(self, which: np.ndarray) -> list[bytes]:
        """The words of some n-grams, one blank between two."""
        words, at, to = one_blank(self.data, _IS_WORD[self.data], self.start, self.end)
        first = self.at[which]
        return [words[i:j] for i, j in zip(at[first].tolist(), to[first + self.size[which] - 1].tolist())]

    def langs_of(self, which: np.ndarray) -> np.ndarray:
        return self.langs[self.doc[self.at[which]]]


def _blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Block]:
    """lang, text → blocks."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            yield _Block(data, offsets, batch.column(0).slice(a, b - a).to_pylist(), longest)


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a hash in the first 32 bits, its key there in the others."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return ((high * np.uint64(parts)) & ~np.uint64(0xFFFFFFFF)) | low


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first, dtype=np.int64)


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    where = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(where.tobytes()), pa.py_buffer(values.tobytes())])


def _pairs(batches: Iterator[pa.RecordBatch], longest: int, parts: int) -> Iterator[pa.RecordBatch]:
    """First pass of a task: part, keys, counts."""

    def sent(pending: list) -> pa.RecordBatch:
        keys, counts = _added(*(np.concatenate(x) for x in zip(*pending)))
        part = (keys >> np.uint64(32)).astype(np.int32)
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        arrays = [pa.array(part[edges[:-1]]), _packed(low, edges), _packed(counts.astype("<i8"), edges)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "keys", "counts"])

    pending, held = [], 0
    for block in _blocks(batches, longest):
        if len(block.hashes):
            keys, counts = np.unique(_keys(block.hashes, parts), return_counts=True)
            pending.append((keys, counts.astype(np.uint32)))
            held += len(pending[-1][0])
        if held >= _FLUSH:
            yield sent(pending)
            pending, held = [], 0
    if pending:
        yield sent(pending)


class Summary:
    """Misra-Gries: every key of ``least`` or more occurrences keeps a counter, and no more than ``taken`` less than it has."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.taken = capacity, least, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Pairs of keys and counts; also those of another summary, whose ``taken`` is then added to this one."""
        keys, counts = _added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        while len(keys) > self.capacity:
            beyond = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            if self.taken + beyond >= self.least:
                self.capacity *= 2
                continue
            self.taken += beyond
            keys, counts = keys[counts > beyond], counts[counts > beyond] - beyond
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        return self.keys[self.counts + self.taken >= self.least]


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the survivors' table for each key."""
    h = mix(keys ^ _ODD)
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask], axis=1).astype(np.int64)


def _survivors(pairs: DataFrame, capacity: int, least: int) -> DataFrame:
    def summary(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pending, held = Summary(capacity, least), [], 0

        def add() -> None:
            found.add(*(np.concatenate(x) for x in zip(*pending)))

        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                pending.append((np.frombuffer(keys.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<i8")))
                held += len(pending[-1][0])
                if held >= capacity:
                    add()
                    pending, held = [], 0
        if pending:
            add()
        part = np.uint64(key[0].as_py() << 32)
        yield pa.RecordBatch.from_arrays([pa.array((part | found.survivors().astype(np.uint64)).view(np.int64))], ["key"])

    return pairs.groupBy("part").applyInArrow(summary, "key long")


def _table(survivors: DataFrame) -> tuple[np.ndarray, int]:
    """The survivors' bits as bytes, and their number; a power of two, at most ``2 ** MOST_BITS``."""
    n = survivors.count()
    bits = 1 << min(MOST_BITS, max(16, math.ceil(math.log2(max(1, n) * _BITS_EACH))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _places(batch.column(0).to_numpy().view(np.uint64), bits).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(found + 1)], ["place"])  # Spark's bitmaps count from 1

    marked = survivors.mapInArrow(places, "place long")
    chunks = marked.groupBy(F.bitmap_bucket_number("place").alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    table = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in chunks.toLocalIterator():  # bits / 8 bytes in all
        at = (row["chunk"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def _counts(batches: Iterator[pa.RecordBatch], longest: int, parts: int, table, bits: int) -> Iterator[pa.RecordBatch]:
    """Second pass of a task: lang, part, phrases (one a line), times of the n-grams in the table."""
    known, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    times, langs, phrases = np.zeros(0, np.int64), [], []

    def sent() -> pa.RecordBatch:
        names, lang = np.unique(np.concatenate(langs), return_inverse=True)
        part = np.zeros(len(times), np.int64)
        part[place] = (_keys(known, parts) >> np.uint64(32)).astype(np.int64)
        group = lang * parts + part
        order = np.argsort(group, kind="stable")
        group = group[order]
        edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        at = order.tolist()
        lines = [b"\n".join([phrases[i] for i in at[a:b]]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        first = group[edges[:-1]]
        arrays = [
            pa.array(names[first // parts], pa.string()), pa.array((first % parts).astype(np.int32)), pa.array(lines, pa.binary()),
            _packed(times[order].astype("<i8"), edges),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "part", "phrases", "times"])

    for block in _blocks(batches, longest):
        at = _places(_keys(block.hashes, parts), bits)
        live = np.flatnonzero(((table.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))
        if not len(live):
            continue
        found, first, n = np.unique(block.hashes[live], return_index=True, return_counts=True)
        spot = np.searchsorted(known, found)
        old = np.zeros(len(found), bool)
        inside = spot < len(known)
        old[inside] = known[spot[inside]] == found[inside]
        times[place[spot[old]]] += n[old]
        fresh = np.flatnonzero(~old)
        which = live[first[fresh]]
        langs.append(block.langs_of(which))
        phrases += block.phrases(which)
        known = np.insert(known, spot[fresh], found[fresh])
        place = np.insert(place, spot[fresh], np.arange(len(times), len(times) + len(fresh)))
        times = np.concatenate([times, n[fresh]])
        if len(times) >= _PHRASES:
            yield sent()
            known, place, times, langs, phrases = known[:0], place[:0], times[:0], [], []
    if len(times):
        yield sent()


def _exact(counted: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, times of the phrases with ``least`` or more occurrences."""

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for phrases, times in zip(batch.column("phrases"), batch.column("times")):
                for phrase, n in zip(phrases.as_py().split(b"\n"), np.frombuffer(times.as_buffer(), "<i8").tolist()):
                    total[phrase] = total.get(phrase, 0) + n
        kept = [(phrase, n) for phrase, n in total.items() if n >= least]
        arrays = [
            pa.array([key[0].as_py()] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()),
            pa.array([p.count(b" ") + 1 for p, _ in kept], pa.int32()), pa.array([n for _, n in kept], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "words", "times"])

    return counted.groupBy("lang", "part").applyInArrow(added, "lang string, phrase string, words int, times long")


def frequent_ngrams(docs: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, times of all n-grams of ``least`` or more occurrences; lang, n (words) of each language."""
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    totals = saved(texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(_WORD)).cast("long")).alias("n")), "totals")
    mass = longest * (totals.agg(F.sum("n")).first()[0] or 0)
    parts = max(1, math.ceil(mass / MASS))
    capacity = max(16, math.ceil(HEADROOM * mass / parts / least))
    pairs = texts.mapInArrow(lambda b: _pairs(b, longest, parts), "part int, keys binary, counts binary")
    survivors = saved(_survivors(pairs, capacity, least), "survivors")
    table, bits = _table(survivors)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2 ** MOST_BITS bits at most
    counted = texts.mapInArrow(lambda b: _counts(b, longest, parts, shared, bits), "lang string, part int, phrases binary, times binary")
    return saved(_exact(counted, least), "frequent"), totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """Exact: products of 38 digits."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    wide = (a * a).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", wide.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase whose words lie inside a longer candidate that has at least ``share`` of 100 of its occurrences is dropped.
    """
    with scratch_scope(docs.sparkSession):
        frequent, totals = frequent_ngrams(docs, longest, least, lang_col, text_col)
        candidates = frequent.filter("words > 1")
        part = frequent.select(F.col("lang").alias("pl"), F.col("phrase").alias("pp"), F.col("times").alias("pt"))

        def ends(words: Column, k: Column | int) -> tuple[Column, Column]:
            k = k if isinstance(k, Column) else F.lit(k)
            return F.array_join(F.slice("w", F.lit(1), k), " "), F.array_join(F.slice("w", k + 1, words - k), " ")

        # Every cut looks up the occurrences of its two parts.
        cuts = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        left, right = ends(F.col("words"), F.col("k"))
        cuts = cuts.select("lang", "phrase", "words", F.col("times").alias("a"), "k", left.alias("left"), right.alias("right"))
        cuts = cuts.join(part.hint("merge"), (F.col("lang") == F.col("pl")) & (F.col("left") == F.col("pp"))).drop("pl", "pp").withColumnRenamed("pt", "l")
        cuts = cuts.join(part.hint("merge"), (F.col("lang") == F.col("pl")) & (F.col("right") == F.col("pp"))).drop("pl", "pp").withColumnRenamed("pt", "r")
        weakest = cuts.withColumn("cut", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
        scored = weakest.groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))

        # The most frequent longer candidate around each phrase.
        inner = candidates.filter("words > 2").withColumn("w", F.split("phrase", " ")).withColumn(
            "size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))
        )
        inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        around = inner.groupBy(F.col("lang").alias("pl"), F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("pp")).agg(
            F.max("times").alias("outer")
        )
        alone = scored.join(around.hint("merge"), (F.col("lang") == F.col("pl")) & (F.col("phrase") == F.col("pp")), "left").filter(
            F.col("outer").isNull() | (100 * F.col("outer") < share * F.col("a"))
        )
        alone = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        # A place in the order of all languages, less the first place of its language, is the place in the language.
        order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        placed = with_positions(saved(alone, "alone"), order, "place")
        starts = placed.groupBy(F.col("lang").alias("pl")).agg(F.min("place").alias("start"))
        rank = F.col("place") - F.col("start") + 1
        best = placed.join(starts, F.col("lang") == F.col("pl")).withColumn("rank", rank).filter(F.col("rank") <= top).drop("pl")
        words = totals.select(F.col("lang").alias("pl"), "n")
        best = best.join(words, F.col("lang") == F.col("pl")).select(
            "lang", "rank", "phrase", "a", "l", "r", "n", "score"
        )
        return saved(best, "collocations", keep=True)  # top rows of each language
