"""The bounded matcher against the standard library's, window by window."""

import difflib
import random

import numpy as np
import pytest

from corpuscle.functions import closest


def _plain(x, t):
    n = max(8, len(x))
    return max(difflib.SequenceMatcher(None, x, t[i : i + n]).ratio() for i in range(0, max(1, len(t) - n + 1), n // 2))


@pytest.mark.parametrize("letters,size", [("ab", 12), ("abcdefgh ", 30), ("abcdefghijklmnopqrstuvwxyz é", 90), ("abcdefghijklmnopqrstuvwxyz é日", 260), ("ab c", 230)])
def test_ratios_are_the_same(letters, size):
    r = random.Random(size)
    for _ in range(25):
        t = "".join(r.choice(letters) for _ in range(r.randint(1, 6 * size)))
        k = r.randrange(len(t))
        x = list(t[k : k + size])
        for _ in range(r.randint(1, 8)):  # edits, so that the excerpt isn't held
            x.insert(r.randint(0, len(x)), r.choice(letters + "#"))
        x = "".join(x)
        if x not in t:
            assert closest.best_ratio(x, t) == pytest.approx(_plain(x, t), abs=1e-12)


def test_matched_blocks_of_pairs():
    r = random.Random(9)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 25))) for _ in range(2))
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert closest.matched(closest._codes(a), closest._codes(b)) == want


def test_few_windows_are_matched():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    t = " ".join(r.choice(words) for _ in range(6000))
    seen = []
    for _ in range(20):
        k = r.randrange(len(t) - 200)
        x = t[k : k + 80].replace(" ", " - ", 1) + "#"
        got = closest.best_ratio(x, t, seen)
        assert got == pytest.approx(_plain(x, t), abs=1e-12) and got > 0.5
    windows, done = sum(seen[::2]), sum(seen[1::2])
    assert done * 20 < windows


def test_defined_cases():
    assert [closest.best_ratio(*p) for p in ((None, "a"), ("", "a"), ("a", None), ("a", ""), ("b", "abc"), ("zzz", "abc"))] == [0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    assert np.isclose(closest.best_ratio("abcd", "abxcd"), _plain("abcd", "abxcd"))
