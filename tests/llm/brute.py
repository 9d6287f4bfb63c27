"""Plain restatements of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(docs: list[tuple[int, str | None]], width: int = 3, percent: int = 90) -> dict[int, int]:
    """Smallest id reachable by links, over all pairs."""
    sets = {}
    for i, text in docs:
        w = words(ascii_lower(text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            marked |= {i, i + 1, i + 2}
    before, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in before
            before.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked)


def base_licenses(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def targets(sizes: dict[str | None, int], weights=(3, 1, 2), total=1.5) -> dict:
    """Shares by weight; what exceeds twice a source's size is reshared until nothing does."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, mass = total * sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / mass for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: 2 * sizes[s] for s in over}
