"""The conversation trie against a plain one over whole texts, on small and on odd tables."""

import hashlib
import random
import zlib

import pytest

from tabkit.llm.conversation_trie import conversation_trie, prefix_trie, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, depth int, turns string, seq string"


def table(seed, n=260):
    r = random.Random(seed)
    texts = [None, "", "hello", "Ünïcode \U0001f600", "a" * 3000, *("t%d" % i for i in range(6))]
    rows = []
    for c in [*range(n), 1205, 1299, 5000]:
        if c % 100 == 0 and r.random() < 0.4:
            continue  # the base is absent
        same = r.random() < 0.4
        for t in range(r.choice([0, 1, 2, 3, 4, 9])):
            rows.append((c, None if r.random() < 0.05 else t, "user" if t % 2 == 0 else r.choice(["assistant", None]), texts[t % 5] if same else r.choice(texts), 1, 2, "x", "y"))
    for c in range(3000, 3060):  # copies of one long conversation, and one that goes on
        rows += [(c, t, "user", "common %d" % t, 1, 2, "x", "y") for t in range(12 if c < 3059 else 40)]
    return [*rows, rows[3], rows[3], (None, 0, "user", "nobody's", 1, 2, "x", "y")]


def digest(turn):
    role, text = turn[1] or "", turn[2] or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role, text))
    for c in convs:
        convs[c] = [(x[1] or "", x[2] or "") for x in sorted(convs[c], key=lambda x: (x[0] is not None, x[0] or 0, digest(x)))]
    members, ends = {(): []}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
        ends.setdefault(full, []).append(c)
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
    if not convs:
        return []
    children = {p: set() for p in members}
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()), key=repr)


@pytest.mark.parametrize(("limit", "members"), [(100_000, 10_000), (4, 3), (60, 1)])
def test_trie(spark, limit, members):
    rows = table(limit)
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), limit=limit, members=members).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_hot_first_turn_is_dealt_out(spark):
    rows = [(c, t, "user", "same" if t < 3 else f"{c} {t}", 1, 2, "", "") for c in range(1, 400) for t in range(5)]
    lists = turn_lists(spark.createDataFrame(rows, SCHEMA))
    got = {(r.conv_id, r.depth): r for r in prefix_trie(lists, limit=20).collect()}
    assert len(got) == 1 + 3 + 2 * 399
    assert [(got[1, d].n_convs, got[1, d].n_children, got[1, d].n_leaves, got[1, d].saved_tokens) for d in range(4)] == [(399, 1, 399, 3 * 398 * 4), (399, 1, 399, 3 * 398 * 4), (399, 1, 399, 2 * 398 * 4), (399, 399, 399, 398 * 4)]


def test_odd_tables(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 1, "", "")], SCHEMA)).count() == 0
    rows = [(100, None, None, None, 1, 1, "", ""), (101, 0, "user", "x" * 2_000_000, 1, 1, "", ""), *((7, t, "user", f"t{t}", 1, 1, "", "") for t in range(3000))]
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), limit=100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
