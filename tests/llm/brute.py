"""Plain definitions that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def benchmark_words(text: str | None) -> list[str]:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return re.findall(pattern, (text or "").translate(LOWER))


def shingles(text: str | None, size: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def linked(a: frozenset, b: frozenset, percent: int = 80) -> bool:
    both = len(a & b)
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def components(sets: dict) -> dict:
    """Smallest key reachable, by comparing all pairs."""
    label = {k: k for k in sets}
    keys = sorted(sets)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = root(a), root(b)
            if x != y and linked(sets[a], sets[b]):
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def repeated_words(text: str | None) -> int:
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i in range(len(w) - 2):
        if runs[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


def hits(text: str | None, items: dict, window: int = 10) -> tuple[int, list[str]]:
    """Words inside windows of the items, and those items."""
    w = benchmark_words(text)
    inside, found = set(), set()
    for item, item_text in items.items():
        v = benchmark_words(item_text)
        n = min(window, len(v))
        own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in own:
                inside |= set(range(i, i + n))
                found.add(str(item))
    return len(inside), sorted(found)
