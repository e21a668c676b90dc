"""What the operators should give, computed by the plainest means on the driver."""

from __future__ import annotations

import re
from collections import Counter

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, n: int = 5) -> set:
    w = SPACE.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(links, ids) -> dict:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, percent: int = 85) -> dict:
    """doc_id to (n_shingles, component) of [(doc_id, text)], comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    common: Counter = Counter()
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(links, sets)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


WORD = re.compile(r"[^\W_]+")


def leaks(docs, items, least: float = 0.8) -> dict:
    """(doc_id, item_id) to the best similarity of any item-sized window, all windows tried."""
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        for j, u in items:
            v = WORD.findall((u or "").lower())
            if not v or len(v) > len(w):
                continue
            k = min(5, len(v))
            want = Counter(tuple(v[x : x + k]) for x in range(len(v) - k + 1))
            if not {*want} & {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}:
                continue
            for s in range(len(w) - len(v) + 1):
                have = Counter(tuple(w[x : x + k]) for x in range(s, s + len(v) - k + 1))
                both = sum((want & have).values())
                sim = both / sum((want | have).values())
                if sim >= least and sim > out.get((i, j), 0):
                    out[i, j] = sim
    return out


def short_leaks(docs, items, least: float = 0.8) -> dict:
    """(doc_id, item_id) to the similarity of a document that has fewer words than the item, as one window."""
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        for j, u in items:
            v = WORD.findall((u or "").lower())
            k = min(5, len(v))
            if not v or not k <= len(w) < len(v):
                continue
            want, have = (Counter(tuple(x[y : y + k]) for y in range(len(x) - k + 1)) for x in (v, w))
            sim = sum((want & have).values()) / sum((want | have).values())
            if sim >= least:
                out[i, j] = sim
    return out


def targets(sizes: dict, most: float = 3.0) -> dict:
    """Shares of all words by weights 1, 2, 3, repeating, stopped at ``most`` times a size: the level is found by bisection."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total = sum(sizes.values())
    lo, hi = 0.0, most * total + 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * sizes[s], weight[s] * mid) for s in order) < total else (lo, mid)
    return {s: min(most * sizes[s], weight[s] * hi) for s in order}
