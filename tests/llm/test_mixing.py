"""Mixing against a plain computation, on small and on odd tables."""

import hashlib
import random
import re

import pytest

from tabkit.llm import mixing
from tabkit.llm.prefix_sums import prefix_sums

SCHEMA = "doc_id long, text string, source string, size long, target double, key string, part int, before_size long"


def table(seed, n=300, sources=("a", "b", "é", "\U00010000", "￿", None, "")):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", " \t", " ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 200)))]), r.choice(sources) if r.random() > 0.3 else sources[0], 1, 2.0, "k", 3, 4) for i in range(n)]
    return [*rows, rows[5], rows[5], (None, "no id", sources[0], *rows[0][3:]), (3, "same id", sources[0], *rows[0][3:])]


def brute(rows, weights, share, most):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    target, left = {}, share * sum(total.values())
    while True:
        open_ = [s for s in sources if s not in target]
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * total[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = most * total[s]
            left -= target[s]
    out = []
    for s in sources:
        budget = int(target[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        own = sorted((hashlib.md5(f"0:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest(), -1 if r[0] is None else r[0], size(r[1])) for r in rows if r[2] == s)
        for _, doc, n in own:
            cut = min(n, max(0, rest))
            rest -= n
            out.append((None if doc == -1 else doc, n, total[s], round(target[s], 6), epochs * n + cut))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("weights", "share", "most"), [((3.0, 1.0, 2.0), 1.5, 2.0), ((1.0,), 0.4, 1.0), ((5.0, 1.0), 3.7, 4.0)])
def test_mix(spark, seed, weights, share, most):
    rows = table(seed)
    got = mixing.mixing(spark.createDataFrame(rows, SCHEMA).repartition(5), weights, share, most).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == brute(rows, weights, share, most)
    for size, target in {(r.source_size, r.target) for r in got}:
        assert target <= most * size + 1e-9


def test_texts_of_the_mix(spark):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA)
    taken, words = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in mixing.mixing(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    own = {}
    for r in mixing.mixed(df).collect():
        own[r.doc_id] = own.get(r.doc_id, 0) + words(r.text)
    assert own == {k: v for k, v in taken.items() if v}


def test_odd_tables(spark):
    assert mixing.mixing(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = [(1, None, "a", 1, 1.0, "", 0, 0), (2, "", None, 1, 1.0, "", 0, 0)]
    assert {tuple(r) for r in mixing.mixing(spark.createDataFrame(nothing, SCHEMA)).collect()} == {(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)}
    long = [(1, "word " * 400_000, "a", 1, 1.0, "", 0, 0), (2, "one", "b", 1, 1.0, "", 0, 0)]
    got = {r.doc_id: r for r in mixing.mixing(spark.createDataFrame(long, SCHEMA)).collect()}
    assert (got[1].taken, got[2].taken) == (600_000, 2)


def test_prefix_sums_of_a_hot_group(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, null, if(id % 50 = 1, 'b', 'a')) as g", "hash(id) as k", "id % 7 as v")
    got = prefix_sums(df, "g", ["k"], ["v"]).collect()
    sums = {}
    for r in sorted(got, key=lambda r: r.k):
        assert r.before_v == sums.get(r.g, 0)
        sums[r.g] = sums.get(r.g, 0) + r.v
