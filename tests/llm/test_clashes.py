"""Texts whose words or spans clash under polynomial hashes modulo 2**64."""

import numpy as np
import pytest

from tabkit.llm import ngram_join, substring_dedup, suffix_dedup
from tabkit.llm.textbytes import SPACE_WORD, Prefix, Texts, Words, byte_values, digests, shingles

SCHEMA = "doc_id long, text string"


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_the_case_is_real(n):
    one, two = (np.frombuffer(thue_morse(n, *x).encode(), np.uint8) for x in ("ab", "ba"))
    assert Prefix(byte_values(one)).grams(n) == Prefix(byte_values(two)).grams(n)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_clash(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    got = ngram_join.ngram_join(spark.createDataFrame([(1, one), (2, two), (3, one)], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*words[:30], one, *words[31:]])), (2, " ".join([*words[:30], two, *words[31:]])), (3, "\t".join([*words[:30], one, *words[31:]]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 60}


@pytest.mark.parametrize("n", [1024, 2048])
def test_spans_that_clash(spark, n):
    one, two = (" ".join(thue_morse(n, *x)) for x in ("ab", "ba"))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((1, one.split()), (2, two.split()))}
    alike = 100 * len(sets[1] & sets[2]) >= 80 * len(sets[1] | sets[2])
    got = ngram_join.ngram_join(spark.createDataFrame([(1, one), (2, two)], SCHEMA)).collect()
    assert {r.component_id for r in got} == ({1} if alike else {1, 2})
    a, b = thue_morse(n).encode(), thue_morse(n, "b", "a").encode()
    starts = {}
    for d, t in ((1, a), (2, b)):
        for i in range(n - 199):
            starts.setdefault(t[i : i + 200], []).append((d, i))
    gone = {1: set(), 2: set()}
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + 200))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, a.decode()), (2, b.decode())], SCHEMA)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {d: len(x) for d, x in gone.items()}


def test_hashes_of_words_and_shingles():
    data = b"one two\tone" + b"one  two three"
    t = Texts(np.frombuffer(data, np.uint8), np.array([0, 11, len(data)]), 0)
    w = Words(t, SPACE_WORD, False)
    h = w.hashes()
    assert h[0] == h[2] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    joined, start, end = w.joined()
    assert [joined[s:e].tobytes() for s, e in zip(start, end, strict=True)] == [b"one", b"two", b"one", b"one", b"two", b"three"]
    s = shingles(h, np.array([0, 3, 1]), np.array([2, 2, 2]))
    assert s[0] == s[1] != s[2]
    assert shingles(h, np.array([0, 0]), np.array([1, 2]))[1] == s[0]
    assert len(digests([])) == 0
