"""Plain Python versions of the operators, slow and obvious."""

from __future__ import annotations

import math
import re
from collections import defaultdict

WORD = re.compile("[^\x00-/:-@\\[-`{-\x7f]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(ws: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(ws)] if 0 < len(ws) < n else [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def copies(docs: list[tuple]) -> dict:
    """first id and keep, by position, for rows (doc_id, text)."""
    first: dict = {}
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0)):
        first.setdefault(docs[i][1], i)
    return {i: (docs[i][0] if t is None else docs[first[t]][0], t is None or first[t] == i) for i, (_, t) in enumerate(docs)}


def near_pairs(docs: list[tuple], n: int = 3, threshold: float = 0.5) -> set[tuple[int, int]]:
    """All pairs of ids whose sets of n-grams reach the threshold."""
    sets = {(i, frozenset(shingles(words(t), n))) for i, t in docs if i is not None and words(t)}
    out = set()
    for i, a in sets:
        for j, b in sets:
            if i < j and len(a & b) >= threshold * len(a | b) - 1e-9:
                out.add((i, j))
    return out


def components(pairs) -> dict:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def contained(docs: list[tuple], items: list[tuple], n: int = 3, threshold: float = 0.6) -> set[tuple]:
    """(doc_id, item_id, matched, size, position) of all windows good enough, the first best one of each pair."""
    out = set()
    for item, text in set(items):
        ws = words(text)
        if not ws:
            continue
        span = min(n, len(ws))
        s = set(shingles(ws, n))
        need = math.ceil(threshold * len(s) - 1e-9)
        for doc, body in set(docs):
            dw = words(body)
            runs = [tuple(dw[i : i + span]) for i in range(len(dw) - span + 1)]
            best, at = 0, 0
            for p in range(len(runs)):
                got = len(set(runs[p : p + len(ws) - span + 1]) & s)
                if got > best and runs[p] in s:
                    best, at = got, p
            if best >= need:
                out.add((doc, item, best, len(s), at))
    return out


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
