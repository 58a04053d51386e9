"""Brute-force forms of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib

WORD_SPACE = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    out, now = [], []
    for c in text or "":
        if c in WORD_SPACE:
            if now:
                out.append("".join(now))
            now = []
        else:
            now.append(c)
    return out + (["".join(now)] if now else [])


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


class Sets:
    """Disjoint sets whose name is the smallest member."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = self.find(x), self.find(y)
        self.up[max(a, b)] = min(a, b)


def near_classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """Smallest id of the documents that links of similar shingle sets reach."""
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    out = Sets(sets)
    for i, s in sets.items():
        shared = collections.Counter(o for x in s for o in holders[x] if o < i)
        for o, n in shared.items():
            if n >= least * (len(s) + len(sets[o]) - n):
                out.join(i, o)
    return {i: out.find(i) for i in sets}


def without_repeats(rows: list[tuple[int, str | None]], length: int, first: bool) -> dict[int, tuple[int, int, int, str, bytes]]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest, rest with whole characters) by id."""
    raw = {i: (t or "").encode() for i, t in sorted(rows)}
    places = collections.defaultdict(list)
    for i, b in raw.items():
        for s in range(len(b) - length + 1):
            places[b[s : s + length]].append((i, s))
    out = {}
    for i, b in raw.items():
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            found = places[b[s : s + length]]
            if len(found) > 1 and not (first and found[0] == (i, s)):
                cover[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        soft, at = [], 0
        for c in b.decode():
            size = len(c.encode())
            if not all(cover[at : at + size]):
                soft.append(c.encode())
            at += size
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest(), b"".join(soft))
    return out
