"""Plain Python versions of the operators, over lists of dicts."""

from __future__ import annotations

import re
from collections import defaultdict

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = WHITE.findall(lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def id_order(x):
    return (x is None, x if x is not None else 0)


def near_components(rows, percent):
    """(number of shingles, smallest id of the component) of each row."""
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(i, j) for own in holders.values() for i in own for j in own if i < j}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i]["doc_id"])
    return [(len(s), min(groups[find(i)], key=id_order)) for i, s in enumerate(sets)], [find(i) for i in range(len(rows))]


def contamination(text, items):
    """(words, hit flags, item ids) of a text; items: (id, text)."""
    words = PLAIN.findall(lower(text))
    hit, found = [False] * len(words), set()
    for item, content in items:
        own = PLAIN.findall(lower(content))
        for window in {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else ():
            for p in range(len(words) - len(window) + 1):
                if tuple(words[p : p + len(window)]) == window:
                    hit[p : p + len(window)] = [True] * len(window)
                    found.add(item)
    return words, hit, found


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets of sources by filling up round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        full |= over
