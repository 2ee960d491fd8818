"""Plain single-process versions of the operators' definitions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(fold(text))
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def least_reachable(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, width: int, percent: int = 80) -> dict:
    sets = {d: shingles(t, width) for d, t in rows}
    post, links = defaultdict(list), []
    for d, own in sets.items():
        for other in {o for s in own for o in post[s]}:
            both = len(own & sets[other])
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                links.append((d, other))
        for s in own:
            post[s].append(d)
    least = least_reachable(sets, links)
    return {d: (d, len(s), least[d], least[d] == d) for d, s in sets.items()}


def contaminated(docs, items, window: int = 13) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM_WORD.findall(fold(text))
        n = min(window, len(words))
        if n:
            for i in range(len(words) - n + 1):
                windows[tuple(words[i : i + n])].add(str(item))
    out = {}
    for d, text in docs:
        words = ALNUM_WORD.findall(fold(text))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (d, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words))
    return out


def repeats(rows, length: int = 50) -> dict:
    by_doc, out = defaultdict(list), {}
    for d, t in rows:
        by_doc[d].append((t or "").encode())
    seen = set()
    for d in sorted(by_doc):
        for raw in by_doc[d]:
            gone = bytearray(len(raw))
            for i in range(len(raw) - length + 1):
                if raw[i : i + length] in seen:
                    gone[i : i + length] = b"\1" * length
            kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
            spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
            out[d] = (d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        for raw in by_doc[d]:
            seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    return out
