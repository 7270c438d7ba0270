"""Suffix arrays by induced sorting, and permuted common prefixes, on whole arrays.

The passes are those of induced sorting: classify suffixes as smaller or
larger than their right neighbour, sort the leftmost-smaller substrings by one
induction, name them by comparing neighbours, solve the shortened string the
same way, and induce the rest from its order.

An induction orders the larger suffixes by their symbols down to the next
leftmost-smaller suffix and by the place of that one, then the smaller ones
likewise from the larger.  Over few symbols it walks the buckets and treats a
bucket's suffixes together, as a wave, so it is linear; over many, as in
shortened strings, buckets hold a suffix or two, and the runs are ordered
together by doubling their length, in as many steps as the logarithm of the
longest run.
"""

from __future__ import annotations

import numpy as np

#: Symbols from which runs are ordered together in place of bucket by bucket.
MANY = 300


def _small_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last is."""
    n = len(t)
    d = np.zeros(n, np.int8)
    d[:-1] = np.sign(t[1:] - t[:-1])
    d[-1] = 1
    at = np.where(d != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return d[at] > 0


def _by_buckets(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order, bucket by bucket."""
    n, sigma = len(t), len(sizes)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    symbols = np.flatnonzero(sizes)

    def place(sa, at, entries, up):
        chars = t[entries].astype(np.uint16)
        by = np.argsort(chars, kind="stable")
        entries, chars = entries[by], chars[by]
        starts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
        counts = np.diff(np.concatenate((starts, [len(chars)])))
        within = np.arange(len(chars)) - np.repeat(starts, counts)
        sa[at[chars] + within if up else at[chars] - 1 - within] = entries
        at[chars[starts]] += counts if up else -counts

    # the larger suffixes, from left to right
    sa = np.full(n, -1, np.int64)
    at = heads.copy()
    by_char = t[lms]
    edges = np.searchsorted(by_char, np.arange(sigma + 1)) if len(lms) else np.zeros(sigma + 1, int)
    for c in symbols:
        done = heads[c]
        while done < at[c]:
            entries = sa[done : at[c]].copy()
            done = at[c]
            before = entries[entries > 0] - 1
            before = before[~small[before]]
            if len(before):
                place(sa, at, before, True)
        entries = lms[edges[c] : edges[c + 1]]
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        if len(before):
            place(sa, at, before, True)
    larger_end = at
    # the smaller ones, from right to left
    at = ends.copy()
    for c in symbols[::-1]:
        done = ends[c]
        while done > at[c]:
            entries = sa[at[c] : done][::-1].copy()
            done = at[c]
            before = entries[entries > 0] - 1
            before = before[small[before]]
            if len(before):
                place(sa, at, before, False)
        entries = sa[heads[c] : larger_end[c]][::-1]
        before = entries[entries > 0] - 1
        before = before[small[before]]
        if len(before):
            place(sa, at, before, False)
        if c == 0:
            sa[0] = n - 1
    return sa


def _runs_in_order(t: np.ndarray, kind: np.ndarray, seed: np.ndarray, place: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a kind in order, and the place of the first of those that are alike (only where seeds' places are).

    ``place``: the places of the seeds, the suffixes that runs of the kind end
    in.  Of equal symbols the kind comes after the seeds if ``last``.
    """
    own = np.flatnonzero(kind)
    to = np.concatenate((own, seed))
    # a symbol and whether it starts a seed, whose place tells seeds apart
    is_seed = np.arange(len(to)) >= len(own)
    key = (t[to] * 2 + (is_seed != last)) * (len(t) + 1)
    key[len(own) :] += place + 1
    rank = np.zeros(len(t) + 1, np.int64)
    step = np.full(len(t) + 1, len(t), np.int64)  # the suffix so many symbols on, within the run; none after a seed
    step[own] = own + 1
    live, base, first = to, np.ones(len(to), np.int64), True
    while len(live):
        if not first:
            after = rank[step[live]]
            live, after = live[after > 0], after[after > 0]
            base = rank[live]
            key = base * (len(t) + 2) + after
        by = np.argsort(key, kind="stable")
        live, key, base = live[by], key[by], base[by]
        at = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], base[1:] != base[:-1])), at, 0)) if len(live) else at
        new = np.concatenate(([True], key[1:] != key[:-1]))[: len(live)]
        rank[live] = base + np.maximum.accumulate(np.where(new, at, 0)) - group if len(live) else base
        if not first:
            step[own] = step[step[own]]
        # what is alone is in its place; what ends alike stays together
        live = live[~(new & np.append(new[1:], True)) & kind[live]] if len(live) else live
        first = False
    by = np.argsort(rank[own], kind="stable")
    return own[by], rank[own[by]]


def _by_runs(t: np.ndarray, small: np.ndarray, lms: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The same from leftmost-smaller suffixes with places, all runs together."""
    n = len(t)
    larger, group = _runs_in_order(t, ~small, lms, place, False)
    kind = small.copy()
    kind[n - 1] = False
    # the smaller suffixes' runs end in a larger one, or in the end mark
    at = np.full(n, -1, np.int64)
    at[larger] = group
    ends = np.flatnonzero(~small & np.concatenate(([False], small[:-1])))
    seed, of = np.append(ends, n - 1), np.append(at[ends], 0)
    smaller, _ = _runs_in_order(t, kind, seed, of, True)
    out = np.concatenate(([n - 1], larger, smaller))
    return out[np.argsort(t[out] * 2 + small[out], kind="stable")]


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings (in the order of ``lms``), equal where the substrings are."""
    n = len(t)
    to = np.empty(n, np.int64)
    to[lms] = np.append(lms[1:] + 1, n)
    size = to[ordered] - ordered
    same = np.zeros(len(ordered), bool)
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    depth = 0
    while len(live):
        done = size[live] == depth
        same[live[done]] = True
        live = live[~done]
        live = live[t[ordered[live] + depth] == t[ordered[live - 1] + depth]]
        depth += 1
    names = np.empty(n, np.int64)
    names[ordered] = np.cumsum(~same) - 1
    return names[lms]


def _sorted(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string that ends in its only least symbol, 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _small_types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    few = int(t.max()) < MANY
    sizes = np.bincount(t) if few else None
    if len(lms) > 1:
        seed = lms[np.argsort(t[lms], kind="stable")]
        symbol = np.unique(t[seed], return_inverse=True)[1]
        sa = _by_buckets(t, small, seed, sizes) if few else _by_runs(t, small, seed, symbol)
        short = _named(t, lms, sa[is_lms[sa]])
        lms = lms[np.argsort(short) if int(short.max()) == len(lms) - 1 else _sorted(short)]
    return _by_buckets(t, small, lms, sizes) if few else _by_runs(t, small, lms, np.arange(len(lms)))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of integers from 1; a smallest end mark is added and left out again."""
    return _sorted(np.concatenate((t.astype(np.int64), [0])))[1:]


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the symbols (``most`` at most) it shares with its left neighbour in the suffix array.

    Only where the symbols before a place and before that neighbour differ
    are symbols compared; elsewhere the value is one less than the place
    before has.  Ends of the array match nothing.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    irreducible = (phi <= 0) | (place == 0)
    irreducible |= t[place - 1] != t[np.maximum(phi - 1, 0)]
    at = np.flatnonzero(irreducible & (phi >= 0))
    value = np.zeros(n, np.int64)
    other, length = phi[at].copy(), np.zeros(len(at), np.int64)
    live, i, j = np.arange(len(at)), at.copy(), other
    while len(live):
        ok = (i < n) & (j < n)
        ok[ok] = t[i[ok]] == t[j[ok]]
        live, i, j = live[ok], i[ok] + 1, j[ok] + 1
        length[live] += 1
    value[at] = length
    last = np.maximum.accumulate(np.where(irreducible, place, 0))
    return np.minimum(np.maximum(value[last] - (place - last), 0), most)
