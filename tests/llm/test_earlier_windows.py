"""Shards of op 10 where passes part contents again."""

import random

import numpy as np

from tabkit.llm.repeats import Unit
from tabkit.llm.substring_dedup import earlier_windows


def windows(contents, counts, least, w):
    split, first = [c.split() for c in contents], {}
    places = [(i, k, tuple(s[k : k + w])) for i, s in enumerate(split) for k in range(len(s) - w + 1)]
    for i, _, g in places:
        first[g] = min(first.get(g, least[i]), least[i])
    return {(i, k, first[g] < least[i]) for i, k, g in places if first[g] < least[i] or counts[i] > 1}


def solved(contents, counts, least, w):
    got = earlier_windows(contents, np.array(counts), np.array(least), np.zeros(len(contents), np.int64), Unit(True, w, 1))
    return {(int(i), k, bool(x)) for i, a, z, x in zip(*got, strict=True) for k in range(a, z)}


def test_pieces_of_contents_are_parted():
    # what the third holds of the second is cut off it; the word there is no part of the piece that stays
    contents = [b"k k k", b"y p q r", b"x p q r", b"z z z"]
    assert solved(contents, [1] * 4, [1, 2, 3, 4], 3) == {(2, 1, True)}


def test_random_contents():
    for seed in range(300):
        r = random.Random(seed)
        w, letters = r.choice([2, 3, 5]), "abc"[: r.randint(2, 3)]
        contents = sorted({" ".join(r.choices(letters, k=r.randint(w, w + 8))).encode() for _ in range(r.randint(1, 9))})
        counts, least = r.choices([1, 2], k=len(contents)), r.choices(range(6), k=len(contents))
        assert solved(contents, counts, least, w) == windows(contents, counts, least, w)
