"""Plain Python counterparts of the corpus operators, over lists of rows."""

from __future__ import annotations

import hashlib
from collections import Counter


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def jaccard_components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest reachable id, by union-find over exact links."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    lists: dict[tuple, list[int]] = {}
    for k, (_, s) in enumerate(sets):
        for shingle in s:
            lists.setdefault(shingle, []).append(k)
    for k, (i, s) in enumerate(sets):
        for j, both in Counter(j for shingle in s for j in lists[shingle] if j > k).items():
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def key_of(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    where: dict[str, set[int]] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                where.setdefault(key_of(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key_of(x), ())) > 1 and min(where[key_of(x)]) < i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repeated_words(w: list[bytes], window: int = 8) -> int:
    grams = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
    often = Counter(grams)
    inside = {k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(window)}
    return len(inside)


def mixture_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Water filling, one source after another, until none is above twice its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in above}
