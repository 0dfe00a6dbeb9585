"""How well the best window of a text matches an excerpt.

A window's ratio is twice the characters in its matching blocks over the lengths of both. Each block is the longest common run of what is still free between the blocks
around it, the earliest in the excerpt and then in the window. What two windows can reach at most follows from how often they hold each character of the excerpt, which running sums over the text
give for all windows together. Windows are looked at in order of that bound, and when the next bound doesn't exceed the best ratio found, none of the rest can. Blocks are a common
subsequence, so the length of the longest one, a bit-parallel sum for all of the excerpt's characters at once, is a nearer bound; only windows that it doesn't exclude are matched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

# Fixed values that ratios depend on: the shortest window, and that a text of so many characters or more lets no run begin with characters that make up more than a hundredth of it.
SHORTEST, CROWDED = 8, 200


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


def _longest(a: np.ndarray, b: np.ndarray, begins: np.ndarray) -> tuple[int, int, int]:
    """Place in a, place in b, and length of the longest common run of characters that may begin one."""
    best = (0, 0, 0)
    runs = np.zeros(len(b) + 1, np.int32)
    for i, c in enumerate(a):
        longer = np.zeros_like(runs)
        here = np.flatnonzero((b == c) & begins)
        longer[here + 1] = runs[here] + 1
        if len(here) and (m := int(longer.max())) > best[2]:
            j = int(longer.argmax())
            best = (i + 1 - m, j - m, m)
        runs = longer
    return best


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """The characters in matching blocks."""
    begins = np.ones(len(b), bool)
    if len(b) >= CROWDED:
        _, back, times = np.unique(b, return_inverse=True, return_counts=True)
        begins = times[back.ravel()] <= len(b) // 100 + 1
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        p, q, r, s = open_.pop()
        if p == q or r == s:
            continue
        i, j, n = _longest(a[p:q], b[r:s], begins[r:s])
        i, j = i + p, j + r
        while i > p and j > r and a[i - 1] == b[j - 1]:  # a run may go on with any character
            i, j, n = i - 1, j - 1, n + 1
        while i + n < q and j + n < s and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            open_ += [(p, i, r, j), (i + n, q, j + n, s)]
    return total


def _common(places: dict[int, int], size: int, b: np.ndarray) -> int:
    """The length of the longest common subsequence. places: for each character of a text of `size` the bits at which it stands."""
    free = whole = (1 << size) - 1
    for c in b.tolist():
        if bits := places.get(c):
            met = free & bits
            free = (free + met | free - met) & whole
    return size - free.bit_count()


def best_ratio(excerpt: str | None, text: str | None, counts: list | None = None) -> float:
    """The best ratio of a window as long as the excerpt, windows beginning at every half of that; 1 if the text holds the excerpt, 0 if one of both is empty.
    counts gets how many windows there are and how many were matched."""
    if not excerpt or not text:
        return 0.0
    if excerpt in text:
        return 1.0
    x, t = _codes(excerpt), _codes(text)
    size = max(SHORTEST, len(x))
    start = np.arange(0, max(1, len(t) - size + 1), size // 2)
    end = np.minimum(start + size, len(t))
    common = np.zeros(len(start), np.int64)
    for c, n in zip(*np.unique(x, return_counts=True)):
        sums = np.concatenate([[0], np.cumsum(t == c)])
        common += np.minimum(sums[end] - sums[start], n)
    most = 2.0 * common / (len(x) + end - start)
    places: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        places[c] = places.get(c, 0) | 1 << i
    best, done = 0.0, 0
    for k in np.argsort(-most, kind="stable"):
        if most[k] <= best:
            break
        window, both = t[start[k] : end[k]], len(x) + end[k] - start[k]
        if 2.0 * _common(places, len(x), window) / both > best:
            done += 1
            best = max(best, 2.0 * matched(x, window) / both)
    if counts is not None:
        counts += [len(start), done]
    return float(best)


def closest_window(excerpt: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_ratio(x, t) for x, t in zip(excerpt, text)], dtype="float64")
