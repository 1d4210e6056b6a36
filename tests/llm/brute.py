"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard_components(docs: dict[int, str | None], n: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {k: shingle_set(t, n) for k, t in docs.items()}
    by_shingle: dict = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    parent = {k: k for k in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    common: dict = {}
    for k, s in sets.items():
        seen: dict = {}
        for x in s:
            for o in by_shingle[x]:
                if o < k:
                    seen[o] = seen.get(o, 0) + 1
        for o, both in seen.items():
            if den * both >= num * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    del common
    return {k: (len(sets[k]), root(k)) for k in docs}


def repeated_bytes(docs: dict[int, str | None], length: int) -> dict[int, tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans, kept bytes."""
    seen, out = set(), {}
    for k in sorted(docs):
        data = (docs[k] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out
