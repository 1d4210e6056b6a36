"""Byte-level BPE encoding and decoding with a public vocabulary.

Boundaries between pieces are found without a regular expression. Every code point has a class (letter,
number, space, other white space, apostrophe that begins a contraction, other); a small automaton says whether a
piece starts at a code point. Each class is a function from state to state. These functions are closed under
composition and there are few of them, so a block of text is scanned by composing function numbers through a
table (the composition is associative): all rows of a grid at once, then the row totals, then the states. Document
beginnings are constant functions, so documents never touch.

The pieces are slices of the text's bytes. Arrow finds the distinct ones of a block; those that are no token
themselves are merged all together, as rows of a matrix: in each round every row merges its pair of lowest rank, and ranks of
pairs come from a hash table of all splits of tokens. Only long pieces, and lengths of which a block has few, are merged one by one.
Ids, their byte offsets and the decoded bytes of a block come from the distinct pieces by array indexing.

Defined results: a null text is an empty text, which has no ids and decodes to nothing; invalid UTF-8 is
replaced as ``make_valid_utf8`` does; a piece of any length is merged in n log n steps; rows repeated whole are encoded
alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.tokens import buffers, list_array, ranges, text_blocks

# Classes of code points, and of apostrophes before one or two letters of a contraction.
_OTHER, _LETTER, _NUMBER, _SPACE, _WHITE, _SHORT, _LONG = range(7)
# States after a code point: at the document's start, after a space, other white space, letter, number, other,
# with one or two letters of a contraction to come, after a contraction.
_FRESH, _AFTER_SPACE, _AFTER_WHITE, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _ONE_LEFT, _TWO_LEFT, _DONE = range(9)

#: The contractions of the pattern, and the code points with the White_Space property.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

#: Widths of the matrices of pieces (longer ones are merged one by one), the fewest rows worth a matrix, and its most places.
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
FEWEST_ROWS = 32
MATRIX_PLACES = 1 << 18

#: Bound of the cache of pieces merged one by one in one worker: their bytes.
CACHE_BYTES = 16 << 20

_NO_PAIR = np.iinfo(np.int32).max


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    table = np.fromiter(
        ({"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[WHITE_SPACE] = _WHITE
    table[0x20] = _SPACE
    return table


def _next_state(state: int, kind: int) -> int:
    if kind == _LETTER:
        return {_TWO_LEFT: _ONE_LEFT, _ONE_LEFT: _DONE}.get(state, _IN_LETTERS)
    if kind in (_SHORT, _LONG) and state not in (_AFTER_SPACE, _IN_OTHERS):
        return _ONE_LEFT if kind == _SHORT else _TWO_LEFT
    return {_NUMBER: _IN_NUMBERS, _SPACE: _AFTER_SPACE, _WHITE: _AFTER_WHITE}.get(kind, _IN_OTHERS)


def _starts(state: int, kind: int) -> bool:
    """Whether a piece starts at a code point; white space before other text is judged apart."""
    if kind in (_SPACE, _WHITE):
        return state not in (_AFTER_SPACE, _AFTER_WHITE)
    if state == _AFTER_SPACE:
        return False
    if kind == _LETTER:
        return state not in (_IN_LETTERS, _ONE_LEFT, _TWO_LEFT)
    return state != (_IN_NUMBERS if kind == _NUMBER else _IN_OTHERS)


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function (plain, and at a document's start), composition, values, start table."""
    states, kinds = range(9), range(7)
    plain = [tuple(_next_state(s, k) for s in states) for k in kinds]
    fresh = [tuple([_next_state(_FRESH, k)] * len(states)) for k in kinds]
    known = list(dict.fromkeys([tuple(states), *plain, *fresh]))
    at = {f: i for i, f in enumerate(known)}
    rows: list[list[int]] = []
    for i, f in enumerate(known):  # the list grows until it is closed under "first f, then a class"
        for g in plain + fresh:
            h = tuple(g[s] for s in f)
            if h not in at:
                at[h] = len(known)
                known.append(h)
    for f in known:
        rows.append([at[tuple(g[s] for s in f)] for g in known])
    return (
        np.array([at[f] for f in plain], np.int32), np.array([at[f] for f in fresh], np.int32),
        np.array(rows, np.int32).ravel(), np.array(known, np.uint8),
        np.array([[_starts(s, k) for k in kinds] for s in states], bool),
    )


def _states_before(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """State before each code point; ``first`` are the places where documents begin."""
    plain, fresh, compose, values, _ = _automaton()
    n, size = len(kinds), len(values)
    step = plain[kinds]
    step[first] = fresh[kinds[first]]
    columns = max(1, int(n**0.5) // 4)
    rows = -(-n // columns)
    grid = np.zeros(rows * columns, np.int32)  # 0 is the identity
    grid[:n] = step
    grid = np.ascontiguousarray(grid.reshape(rows, columns).T)
    for c in range(1, columns):
        grid[c] = compose[grid[c - 1] * size + grid[c]]
    state, carried = _FRESH, np.zeros(rows, np.uint8)
    for r, total in enumerate(grid[-1].tolist()):
        carried[r] = state
        state = int(values[total, state])
    after = values[grid, carried[None, :]]
    out = np.empty((columns, rows), np.uint8)
    out[0], out[1:] = carried, after[:-1]
    return np.ascontiguousarray(out.T).ravel()[:n]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which pieces start, for UTF-8 texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    if (data < 0x80).all():
        lead, points = np.arange(len(data)), data.astype(np.int32)
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        head = data[lead]
        points = head.astype(np.int32)
        more = np.zeros(len(data) + 3, np.int32)
        more[: len(data)] = data & 0x3F
        for low, high, mask, extra in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
            rows = np.flatnonzero((head >= low) & (head <= high))
            value = points[rows] & mask
            for k in range(1, extra + 1):
                value = (value << 6) | more[lead[rows] + k]
            points[rows] = value
    kinds = code_point_classes()[np.minimum(points, 0x10FFFF)]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first = np.searchsorted(lead, begin)
    last_of = np.zeros(len(lead) + 2, bool)  # True where the next code point is in another document
    last_of[np.append(first[1:], len(lead)) - 1] = True
    quote = np.flatnonzero(points == 0x27)
    quote = quote[~last_of[quote]]
    one, inside = points[quote + 1], ~last_of[quote + 1]
    two = np.zeros(len(quote), points.dtype)
    two[inside] = points[quote[inside] + 2]
    kinds[quote[np.isin(one, [ord(c) for c in ONE_LETTER])]] = _SHORT
    for a, b in TWO_LETTERS:
        kinds[quote[(one == ord(a)) & (two == ord(b))]] = _LONG
    state = _states_before(kinds, first)
    state[first] = _FRESH
    start = _automaton()[4][state, kinds]
    start[first] = True
    white = (kinds == _SPACE) | (kinds == _WHITE)
    start[:-1] |= white[:-1] & ~white[1:] & ~last_of[: len(lead) - 1]
    return lead[start].astype(np.int64)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the pair of lowest rank first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, alive = list(range(1, n + 1)), [True] * n  # part i spans bytes i .. end[i]
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, to = heapq.heappop(queue)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != to:
            continue  # one of the two parts has been merged meanwhile
        end[i], alive[j] = to, False
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(queue, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
            heapq.heappush(queue, (r, h, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Rank of the token that two neighbouring parts make, for arrays of parts.

    A part is a token's rank; bytes that are no tokens have numbers from ``unknown`` on.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.unknown = max(ranks.values(), default=-1) + 1
        number = {bytes([b]): self.unknown + b for b in range(256)} | ranks
        self.byte = np.array([number[bytes([b])] for b in range(256)], np.int32)
        self.width = self.unknown + 256
        found = [
            (number[token[:k]] * self.width + number[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in number and token[k:] in number
        ]
        key, rank = np.array(found, np.int64).reshape(-1, 2).T
        bits = max(8, (3 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        place, slot, rest = np.full(1 << bits, -1, np.int64), self._slot(key), np.arange(len(key))
        while len(rest):  # open addressing: who finds a place taken goes on to the next
            free = rest[place[slot[rest]] < 0]
            place[slot[free]] = free
            rest = rest[place[slot[rest]] != rest]
            slot[rest] = (slot[rest] + 1) & self.mask
        used = place >= 0
        self.keys, self.ranks = np.full(len(place), -1, np.int64), np.full(len(place), _NO_PAIR, np.int32)
        self.keys[used], self.ranks[used] = key[place[used]], rank[place[used]]
        self.of_bytes = self(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``_NO_PAIR`` for pairs that make no token or where a part is missing (below 0)."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left.astype(np.int64) * self.width + right)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], np.int32(_NO_PAIR))
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge`` for many pieces of up to ``width`` bytes: ids of all in turn, and their number in each."""
        column = np.arange(width + 1)
        text = data[np.minimum(start[:, None] + column, len(data) - 1)]
        inside = column < length[:, None]
        parts = np.where(inside, self.byte[text], np.int32(-1))  # the last column stays free
        pair = np.where(inside[:, 1:], self.of_bytes[text[:, :-1].astype(np.int32) << 8 | text[:, 1:]], np.int32(_NO_PAIR))
        out, row = np.full(parts.shape, -1, np.int32), np.arange(len(start))
        while len(row):
            at, here = pair.argmin(axis=1), np.arange(len(row))  # the leftmost of equal ranks
            best = pair[here, at]
            done = best == _NO_PAIR
            if done.any():
                out[row[done], : parts.shape[1]] = parts[done]
                go = ~done
                row, parts, pair, at, best = row[go], parts[go], pair[go], at[go], best[go]
                here = here[: len(row)]
            if not len(row):
                break
            parts[here, at] = best
            stays = np.ones(parts.shape, bool)
            stays[here, at + 1] = False
            parts = parts[stays].reshape(len(row), -1)
            stays = np.ones(pair.shape, bool)
            stays[here, at] = False
            pair = pair[stays].reshape(len(row), -1)
            # with the neighbours left and right; to the left of the first part lies the free last column
            fresh = self(np.concatenate([parts[here, at - 1], best]), np.concatenate([best, parts[here, at + 1]]))
            pair[here, at - 1], pair[here, at] = fresh[: len(row)], fresh[len(row) :]
        real = out >= 0
        ids = out[real]
        if len(ids) and ids.max() >= self.unknown:
            raise KeyError("a byte of the text is no token")
        return ids, real.sum(axis=1)


class Codec:
    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.vocabulary = pa.array(list(self.ranks), pa.large_binary())
        self.rank = np.array(list(self.ranks.values()), np.int32)
        self.single: dict[bytes, np.ndarray] = {}
        self.single_bytes = 0
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def _merge_single(self, piece: bytes) -> np.ndarray:
        if piece not in self.single:
            if self.single_bytes > CACHE_BYTES:
                self.single, self.single_bytes = {}, 0
            self.single[piece] = np.array(merge(piece, self.ranks), np.int32)
            self.single_bytes += len(piece)
        return self.single[piece]

    def merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, those of each one behind another, and where these begin and how many they are."""
        data, offsets = buffers(pieces)
        length = np.diff(offsets)
        token = pc.index_in(pieces, value_set=self.vocabulary)
        known = token.is_valid().to_numpy(zero_copy_only=False)
        ids = [self.rank[token.drop_null().to_numpy()]]
        count = known.astype(np.int64)
        begin = np.cumsum(count) - count
        filled = len(ids[0])
        fit = np.searchsorted(WIDTHS, length)
        fit[known] = -1
        alone = [np.flatnonzero(fit == len(WIDTHS))]
        for k, width in enumerate(WIDTHS):
            rows = np.flatnonzero(fit == k)
            if len(rows) < FEWEST_ROWS:
                alone.append(rows)
                continue
            for part in np.array_split(rows, -(-len(rows) * width // MATRIX_PLACES)):
                found, count[part] = self.pairs.merge(data, offsets[part], length[part], width)
                begin[part] = filled + np.cumsum(count[part]) - count[part]
                ids.append(found)
                filled += len(found)
        for i in np.concatenate(alone).tolist():
            found = self._merge_single(data[offsets[i] : offsets[i + 1]].tobytes())
            begin[i], count[i] = filled, len(found)
            ids.append(found)
            filled += len(found)
        return np.concatenate(ids), begin, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in turn, and their number in each document."""
        start = piece_starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        where = pa.py_buffer(np.append(start, len(data)))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, where, pa.py_buffer(data)]).dictionary_encode()
        code = pieces.indices.to_numpy()
        pool, begin, count = self.merged(pieces.dictionary)
        length = count[code]
        ids = pool[ranges(begin[code], length)]
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, np.diff(total[np.searchsorted(start, offsets)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in turn, and the number of bytes of each."""
        length = self.token_length[ids]
        return self.pool[ranges(self.token_start[ids], length)], length


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    """Append ids, their byte offsets in the text, and the decoded bytes to batches whose column ``at`` is the text."""
    tool = codec(path)
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(at)):
            ids, counts = tool.encode(data, offsets)
            raw, length = tool.decode(ids)
            sizes = np.concatenate([[0], np.cumsum(length)])
            first = np.concatenate([[0], np.cumsum(counts)])
            place = sizes[:-1] - np.repeat(sizes[first[:-1]], counts)
            where = pa.py_buffer(sizes[first].astype(np.int32))
            decoded = pa.Array.from_buffers(pa.binary(), b - a, [None, where, pa.py_buffer(raw)])
            part = batch.slice(a, b - a)
            keep = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [n for i, n in enumerate(part.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*keep, list_array(ids, counts, pa.int32()), list_array(place, counts, pa.int32()), decoded],
                [*names, "ids", "offsets", "decoded"],
            )


def bpe(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ids array<int>, offsets array<int> (of each id in the UTF-8 text), decoded binary."""
    rows = docs.select(*keep, F.make_valid_utf8(F.col(text_col)).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kept}{', ' if kept else ''}ids array<int>, offsets array<int>, decoded binary"
    at = len(keep)
    return rows.mapInArrow(lambda batches: encode_batches(batches, path, at), schema)
