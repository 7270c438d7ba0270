"""The corpus operators against brute force, on small and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabkit.llm import decontam, frames, langid, license_scan, media, ngram_join, packing, quality, repeats, sais, substring_dedup, suffix_dedup, token_counts
from tabkit.llm.fmindex import FMIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, first string"


def corpus(seed=1, n=60):
    """Null, empty, blank, short, long, repetitive, repeated and nearly repeated texts, under clashing column names."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéÀ\0") for _ in range(r.randint(1, 7))) for _ in range(300)]
    some = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = some(70)
    texts = [None, "", "  \n", "one two", "ONE two", "a " * 400, "x" * 5000]
    for _ in range(n):
        t = some(r.randint(1, 260))
        texts.append(t)
        if r.random() < 0.3:
            texts += [t, t.replace(" ", "\t", 1)]
        if r.random() < 0.3:
            w = t.split()
            w[r.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
        if r.random() < 0.3:
            texts.append(some(r.randint(0, 30)) + " " + passage + " " + some(r.randint(0, 30)))
    rows = [(i, t, "en", "s", None, "t", "f") for i, t in enumerate(texts)]
    return [*rows, rows[10], (10, "another text of the same id", None, None, None, None, None), (None, texts[10], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.lower() if lower else data)


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_suffix_array_and_fm_index():
    r = np.random.default_rng(3)
    for _ in range(150):
        t = r.integers(1, r.integers(2, 6) + 1, r.integers(1, 60))
        order = sais.suffix_array(t)
        assert list(order) == sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        shared = sais.permuted_common_prefixes(t, order, 10**9)
        for a, c in zip(order, order[1:], strict=False):
            k = 0
            while max(a, c) + k < len(t) and t[a + k] == t[c + k]:
                k += 1
            assert shared[c] == k
        index = FMIndex(t, 6)
        pattern = np.concatenate((r.integers(1, 8, 40), t[: len(t) // 2]))
        start, end = np.array([0, 15, 40]), np.array([15, 40, len(pattern)])
        got, text = index.matching(pattern, start, end), [tuple(t[i : i + k]) for k in range(8) for i in range(len(t))]
        for a, z in zip(start, end, strict=True):
            for i in range(a, z):
                longest = max(k for k in range(7) if i + k <= z and tuple(pattern[i : i + k]) in text)
                assert min(got[i], 6) == longest


def test_suffix_arrays_of_recursive_words(monkeypatch):
    """Words that need many levels of shortened strings, with either order of runs."""
    thue = np.array([bin(i).count("1") % 2 + 1 for i in range(2048)])
    fibonacci = [1], [1, 2]
    while len(fibonacci[1]) < 1500:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for many in (sais.MANY, 2):
        monkeypatch.setattr(sais, "MANY", many)
        for t in (thue, np.array(fibonacci[1]), np.ones(500, int), np.arange(900) % 450 + 1, np.zeros(0, int)):
            own = t.astype(">u2").tobytes()
            assert list(sais.suffix_array(t)) == sorted(range(len(t)), key=lambda i: own[2 * i :])


def test_the_index_decides_what_is_removed(monkeypatch):
    """Later contents are not in the index that they are streamed against; without it nothing is found."""
    unit = substring_dedup.Unit(True, 3, 2)
    contents = [b"a b c d e", b"x b c d y", b"q r s t", b"b c d", b"q r s"]
    counts, least, anchor = np.array([1, 1, 2, 1, 1]), np.array([4, 7, 9, 5, 9]), np.zeros(5, np.int64)
    asked = []
    real = FMIndex.matching
    monkeypatch.setattr(FMIndex, "matching", lambda self, pattern, a, z: (asked.append((self.rows, len(pattern))), real(self, pattern, a, z))[1])
    got = {tuple(int(v) for v in x) for x in zip(*substring_dedup.earlier_windows(contents, counts, least, anchor, unit), strict=True)}
    # b c d is in document 4; q r s t is in two documents, of which the least keeps it, as does q r s in the same document
    assert got == {(1, 1, 2, 1), (3, 0, 1, 1), (2, 0, 2, 0)} and asked
    monkeypatch.setattr(FMIndex, "matching", lambda self, pattern, a, z: np.zeros(len(pattern), np.int64))
    assert {tuple(int(v) for v in x) for x in zip(*substring_dedup.earlier_windows(contents, counts, least, anchor, unit), strict=True)} == {(2, 0, 2, 0)}


def test_windows_of_bytes_do_not_cross_contents():
    """A byte 0 is no end of a content."""
    unit = suffix_dedup.Unit(False, 5, 2)
    run = lambda contents: list(zip(*(x.tolist() for x in suffix_dedup.repeated_windows(contents, np.ones(len(contents)), None, None, unit)), strict=True))
    assert run([b"abcde", b"fghij", b"cde\0fg"]) == []
    assert run([b"ab\0de", b"xab\0dey"]) == [(0, 0, 1, True), (1, 1, 2, True)]


def linked_by_force(rows):
    """(doc_id, n_shingles, component_id) of each (doc_id, text)."""
    sets = []
    for r in rows:
        w = words(r.text, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            linked = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if linked or rows[i].doc_id is not None and rows[i].doc_id == rows[j].doc_id and sets[i] and sets[j]:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(sets[i]), least.get(root(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows)), key=repr)


def test_ngram_join(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    assert rows_of(ngram_join.ngram_join(docs), "doc_id", "n_shingles", "component_id") == linked_by_force(rows)
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """Components beyond a unit are cut into blocks, or their lists are; chains, rows without doc_id and null texts link as any."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts, chain = [], list(base)
    for k in range(90):
        w = list(base)
        for at in r.sample(range(60), r.randint(0, 2)):
            w[at] = f"x{k}"
        texts.append(" ".join(w))
        chain[r.randrange(60)] = f"y{k}"
        texts.append(" ".join(chain))
        texts.append(" ".join([*base[:12], *(f"z{k}-{i}" for i in range(r.randint(1, 50)))]))
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1000, None), (1001, texts[0]), (-5, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = linked_by_force(df.collect())
    for name in ("SETS", "BLOCK", "SOME"):
        monkeypatch.setattr(ngram_join, name, 16)
    assert rows_of(ngram_join.ngram_join(df), "doc_id", "n_shingles", "component_id") == want


def alike_sets(r, n=40, size=60):
    """Clusters of sets that differ in some hashes, in order of clusters."""
    out = []
    for _ in range(n):
        base = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for _ in range(int(r.integers(1, 12))):
            own = base.copy()
            own[r.choice(size, int(r.integers(0, size // 4)), replace=False)] = r.integers(0, 1 << 63, 1, dtype=np.uint64)
            out.append(np.unique(own))
    return out


def test_rtree_finds_every_pair():
    r = np.random.default_rng(0)
    sets = alike_sets(r)
    n = np.array([len(x) for x in sets])
    points = np.stack([np.bincount((x >> np.uint64(53)).astype(int), minlength=ngram_join.GROUPS) for x in sets])
    tree = ngram_join.RTree(points, n)
    for q in range(len(sets)):
        need = -(-80 * (n[q] + n[:q]) // 180)
        bound = np.minimum(points[q], points[:q]).sum(axis=1)
        ok = (bound >= need) & (100 * n[q] >= 80 * n[:q]) & (100 * n[:q] >= 80 * n[q])
        assert sorted(tree.before(q, 80)[0].tolist()) == np.flatnonzero(ok).tolist()
    # inner nodes prune: far fewer points are looked at than there are pairs
    assert len(tree.levels) >= 3 and tree.visited[1] > 0 and tree.visited[0] < 0.5 * len(sets) * (len(sets) - 1) / 2


def test_links_span_what_is_alike():
    sets = alike_sets(np.random.default_rng(1), 25)
    alike = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    part = list(range(len(sets)))
    for i, j in ((i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i].tolist(), sets[j].tolist())):
        part = [part[j] if p == part[i] else p for p in part]
    n, points = np.array([len(x) for x in sets]), ngram_join._counts(sets)
    found = list(ngram_join.links(points, n, np.arange(len(sets)), 80, sets))
    assert len(found) == len(sets) - len(set(part)) and all(alike(sets[a].tolist(), sets[b].tolist()) for a, b in found)
    assert not list(ngram_join.links(points, n, np.array(part), 80, sets))
    # points alone connect at least as much, in half a byte a group too
    points[:, 5] += 40
    for some in (points, ngram_join.unpacked([ngram_join.packed(x) for x in points])):
        above = {i: i for i in range(len(sets))}
        for a, b in ngram_join.links(some, n, np.arange(len(sets)), 80):
            above = {k: above[b] if v == above[a] else v for k, v in above.items()}
        assert all(above[i] == above[j] for i in range(len(sets)) for j in range(i) if part[i] == part[j])


@pytest.mark.parametrize("hot", [repeats.HOT_ROWS, 2])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    rows = docs.select("doc_id", "text").collect()
    own = [(r.doc_id, (r.text or "").encode()) for r in rows]
    starts = Counter(t[k : k + 200] for _, t in own for k in range(len(t) - 199))
    want = []
    for i, t in own:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if starts[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = rows_of(suffix_dedup.suffix_dedup(docs, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT_ROWS, 2])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    rows = docs.select("doc_id", "text").collect()
    own = [(r.doc_id, words(r.text)) for r in rows]
    first = {}
    for i, w in own:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in own:
        gone = [0] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [1] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = rows_of(substring_dedup.substring_dedup(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    texts = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 40]
    items = [(1, " ".join(texts[0].split()[3:30])), (2, "one, TWO"), (3, None), (4, "..."), (5, " ".join(texts[1].split()[:13])), (5, " ".join(texts[1].split()[:13])), (None, "zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for r in docs.select("doc_id", "text").collect():
        w, found = alnum(r.text), set()
        hit = [0] * len(w)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit[k : k + size] = [1] * size
                    found |= windows[tuple(w[k : k + size])] - {None}
        which = ",".join(sorted(map(str, found)))
        want.append((r.doc_id, len(w), sum(hit), len(found), hashlib.sha256(which.encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontam.contamination(docs, bench), *names) == sorted(want, key=repr)
    assert decontam.decontaminated(docs, bench).count() == sum(not x[-1] for x in want)
    assert decontam.decontaminated(docs, bench, cut=True).count() == len(want)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_license_scan(spark, empty):
    texts = [None, "", "MIT License mit license", "cc by, CC-BY", "Licensed under the Apache License, Version 2.0", "mit licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy of my thing to deal in the Software without restriction", "under the GNU General Public License"]
    got = rows_of(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got[2] == (2, 4, 2, 0, 2, "mit", "mit", 0.5)
    assert got[3][2:6] == (2, 0, 2, "cc-by")
    assert got[4][5:] == ("apache", "apache,apache-2.0-notice", 1.0)
    assert got[5][2:] == (0, None, None, "", "", 0.0) and got[0] == (0, 0, 0, None, None, "", "", 0.0)
    assert got[6][5:] == ("", "mit-grant", 1.0) and got[7][5] == "gpl"
    assert license_scan.license_scan(empty).count() == 0


def test_license_texts(spark):
    """Whole wordings with their regions filled; a text that lacks a mandatory word is none."""
    def text(markup, wide):
        full = re.sub(r"<<.*?>>", "some words" if wide else "one", re.sub(r"\[\[(.*?)\]\]", r"\1" if wide else "", markup))
        return " ".join(full.split())

    rows, want = [], []
    for k, (label, markup) in enumerate(license_scan.TEMPLATES.items()):
        full = text(markup, k % 2)
        rows += [(2 * k, f"Foo. {full.upper()} bar"), (2 * k + 1, full.replace(" the ", " a ").rsplit(" ", 2)[0])]
        want.append(label)
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[2 * k] and label not in got[2 * k + 1] for k, label in enumerate(want))
    assert all(re.search(" " + license_scan.pattern(m), f" {text(m, k % 2)} ") for k, m in enumerate(license_scan.TEMPLATES.values()))


def test_queries_against_sql(spark):
    """The SQL of the corpus queries gives their rows."""
    import duckdb

    from tabkit.llm import queries

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=repr), name


ODD = ["lang_pred", "n_shingles", "component_id", "label", "part", "unit", "body", "row", "tag", "piece", "length", "a.b", "hashes"]


def test_odd_tables(spark):
    """A text of a megabyte, columns with any names, and n_chars of another type."""
    r = random.Random(8)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(170_000))
    half = " ".join(long.split()[:87_000])
    rows = [(1, long, 3, *ODD), (2, half, 3, *ODD), (3, None, 3, *ODD), (4, long, None, *ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in ODD))
    assert [x.component_id for x in ngram_join.ngram_join(df).orderBy("doc_id").collect()] == [1, 2, 3, 1]
    assert ngram_join.one_of_each(df).columns == df.columns and ngram_join.one_of_each(df).count() == 3
    got = substring_dedup.cut_earlier_passages(df)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(x.doc_id for x in got.collect()) == [1, 3]
    assert {x.doc_id: x.n_removed for x in suffix_dedup.suffix_dedup(df).collect()} == {1: len(long), 2: len(half), 3: 0, 4: len(long)}
    bench = spark.createDataFrame([(1, " ".join(long.split()[9:30]))], "item_id long, text string")
    assert sum(x.n_hit for x in decontam.contamination(df, bench).collect()) == 63
    assert decontam.decontaminated(df, bench, cut=True).columns == df.columns
    assert license_scan.license_scan(df).agg({"n_words": "max"}).first()[0] == 170_000
    assert packing.best_fit_packing(df).agg({"length": "max"}).first()[0] == 2048
    assert token_counts.token_counts(df).count() == media.media_columns(df).count() == 4


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    """A benchmark beyond a block is scanned block after block, with the same result."""
    texts = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 40]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:6])], "item_id long, text string")
    want = rows_of(decontam.contamination(docs, bench), "doc_id", "n_hit", "items_sha256")
    cut = rows_of(decontam.decontaminated(docs, bench, cut=True), "doc_id", "text")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    tables = []
    monkeypatch.setattr(decontam, "written", lambda df: tables.append(df.columns) or frames.written(df))
    assert rows_of(decontam.contamination(docs, bench), "doc_id", "n_hit", "items_sha256") == want
    assert tables and all("text" not in c for c in tables)  # the corpus is not written again
    assert rows_of(decontam.decontaminated(docs, bench, cut=True), "doc_id", "text") == cut
    odd = spark.createDataFrame([(1, None), (2, ""), (3, None), (None, None)], "doc_id long, text string").unionAll(docs.where("text is not null").select("doc_id", "text").limit(5))
    assert decontam.contamination(odd.unionAll(odd), bench).count() == 2 * odd.count()


def test_license_regions_have_their_own_length(spark):
    grant = "permission is hereby granted free of charge to any person obtaining a copy of {} to deal in the software without restriction"
    rows = [(k, grant.format("word " * k)) for k in (0, 12, 13, 200, 201)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "labels", "score") == sorted([(k, "mit-grant" if k <= 200 else "", 1.0 if k <= 200 else 0.0) for k, _ in rows], key=repr)


CLASHES = ["n_words", "starts", "ends", "items", "lang_pred", "score", "__text", "tag", "spans", "mark", "first", "last", "anchor", "component_id", "a.b"]


def brute_stages(rows, items):
    """The documents each stage keeps, as (doc_id, text), by definition: a letter, least of its component, earlier windows cut, not contaminated."""
    one = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    sets = []
    for _, t in one:
        w = words(t, True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    part = list(range(len(one)))
    for i in range(len(one)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) or one[i][0] is not None and one[i][0] == one[j][0]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {p: min((i for (i, _), q in zip(one, part, strict=True) if q == p and i is not None), default=None) for p in set(part)}
    gone = {i for (i, _), p in zip(one, part, strict=True) if i is not None and least[p] < i}
    two = [(i, t) for i, t in one if i not in gone]
    first = {}
    for i, t in two:
        w = words(t)
        for k in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    three = []
    for i, t in two:
        w = words(t)
        cut = {k + j for k in range(len(w) - 49 if i is not None else 0) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        if len(cut) < len(w) or not cut:
            three.append((i, b" ".join(x for k, x in enumerate(w) if k not in cut).decode() if cut else t))
    windows = {tuple(w[k : k + 13]) for w in map(alnum, items) for k in range(max(1, len(w) - 12) if w else 0)}
    four = []
    for i, t in three:
        w = alnum(t)
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            four.append((i, t))
    return one, two, three, four


def test_pipeline_stages(spark, tmp_path):
    """Each stage and the final pieces against brute force, with columns whose names the helpers use."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers

    long = [r for r in corpus() if len((r[1] or "").split()) > 100]
    rows = [(*r[:5], *(f"{c}{k}" for c in CLASHES)) for k, r in enumerate(corpus())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    items = [" ".join(long[3][1].split()[3:60]), "one, TWO"]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_stages([r[:2] for r in rows], items)
    assert len({len(x) for x in (rows, *want)}) >= 4 and want[1] != want[2]
    by_row = Counter(r[5:] + (r[0],) for r in rows)
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want, strict=False):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [f.split("`")[1] if "`" in f else f.split()[0] for f in schema.split(", ")], name
        got = docs.collect()
        assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(kept, key=repr), name
        assert all(by_row[tuple(r[5:]) + (r[0],)] for r in got), name
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, text in want[3]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            pieces[i, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == pieces


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs, length=64, with_ids=True).collect()
    want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.select("doc_id", "text").collect())
    fills = {}
    for r in got:
        assert len(r.ids) == r.length <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fills.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert len(fills) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1
    assert packing.best_fit_packing(empty).count() == 0


def test_exchanges_empty_bins():
    """Never worse than best fit alone, at the least number where exchanges lead there, and every item once."""
    r = random.Random(5)
    for low, high, size in ((1, 10, 20), (3, 11, 20), (6, 11, 20), (20, 60, 100), (51, 70, 100), (1, 1, 7)):
        for n in (0, 1, 7, 200):
            sizes = [r.randint(low, high) for _ in range(n)]
            got = packing.pack(sizes, size)
            assert sorted(i for b in got for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= size for b in got)
            plain = []
            for s in sorted(sizes, reverse=True):
                fits = [k for k, free in enumerate(plain) if free >= s]
                k = min(fits, key=lambda k: plain[k], default=None)
                if k is None:
                    plain.append(size - s)
                else:
                    plain[k] -= s
            assert len(got) <= len(plain)
    # best fit needs three bins here
    assert sorted(sorted([5, 4, 4, 3, 2, 2][i] for i in b) for b in packing.pack([5, 4, 4, 3, 2, 2], 10)) == [[2, 3, 5], [2, 4, 4]]


def test_tokenizers_agree():
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    for s in ["", " ", "  a  b\n\nc ", "don't we'LL x", "éÀ ß  x", "a<|endoftext|>b", "12 345!? \t\n", "İ 日本 ² x\r\n y", "\nA\tB C\n"]:
        assert encode(s) == t.encode(s, add_special_tokens=False).ids


def test_language_id(spark, empty):
    r = random.Random(0)
    rows = []
    for i in range(400):
        lang, letters = r.choice([("aa", "abcab"), ("zz", "xyzxy")])
        rows.append((i, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20)), lang))
    rows += [(400, None, "aa"), (401, "12 !", "aa"), (402, "", None), (None, "abc", "aa")]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:400])
    assert {by[i].lang_pred for i in (400, 401, 402)} == {"und"} and all(0 <= x.score <= 1 for x in got)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(403))
    assert langid.language_id(empty).count() == 0


def test_quality(spark, empty):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        w = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 9))) for _ in range(60)]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), 0))
    rows += [(600, None), (601, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id", "left").collect()
    held = [x for x in got if x.held_out and x.quality is not None]
    assert sum(x.predicted == x.quality for x in held) >= 0.95 * len(held) and len(got) == 602
    assert quality.quality_scores(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.quality_scores(empty, labels).count() == 0


def test_media(docs, empty):
    for r in media.media_columns(docs).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").where("doc_id <> 10").collect():
        data = (r.text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.media_columns(empty).count() == 0
    wave = (128 + 100 * np.sin(np.arange(16000) * 2 * np.pi * 1000 / 16000) * (np.arange(16000) > 8000)).astype(np.uint8)
    mel, spans = media.features(media.read_back(media.stored(wave.tobytes())))
    assert len(spans) == 1 and abs(spans[0][0] * media.HOP / media.LOW_RATE - 0.5) < 0.05
    t = media.tensors(wave.tobytes())
    assert t.schema.field("log_mel").type.shape == [media.SHAPE, media.MELS]
    x = np.sin(np.arange(4000) * 0.05).astype(np.float32)
    assert np.abs(media.resampled(media.resampled(x), 2, 1)[200:-200] - x[200:-200]).max() < 0.02


def test_media_tensors_and_spans(spark):
    n = np.arange(40000)
    sound = 100 * np.sin(n * 2 * np.pi * 1000 / 16000) * ((n > 8000) & (n < 16000) | (n > 30000))
    payload = bytes((128 + sound).astype(np.uint8))[: 40000 // 192 * 192]
    mel, spans = media.features(payload)
    rows = media.audio_features(spark.createDataFrame([(1, len(payload), bytearray(media.stored(payload)))], "doc_id long, n_bytes long, media binary")).orderBy("part").collect()
    stored = np.array([r.log_mel for r in rows], np.float32).reshape(-1, media.MELS)[: sum(r.frames for r in rows)]
    assert np.array_equal(stored, mel) and rows[-1].end_s == len(payload) / media.RATE
    found = [(x.start_s, x.end_s) for r in rows for x in r.segments]
    assert found == [(a * media.HOP / media.LOW_RATE, z * media.HOP / media.LOW_RATE) for a, z in spans] and len(found) == 2
    assert all(abs(x - y) < 0.05 for got, want in zip(found, [(0.5, 1.0), (1.875, 2.5)], strict=True) for x, y in zip(got, want, strict=True))
    assert all(r.start_s <= x.start_s < r.end_s for r in rows for x in r.segments)
    mean = ",".join(f"{v:.1f}" for v in mel.mean(axis=0, dtype=np.float64))
    assert media.described(media.tensors(payload)).startswith(f"frames={len(mel)};segments=2;voiced={sum(z - a for a, z in spans)};mean={mean};dev=")


def test_token_counts(docs, empty):
    path, pattern = token_counts.default_vocabulary()
    counter = token_counts.Counter(token_counts.vocabulary(path))
    costs, pieces = {}, token_counts.vocabulary(path)
    import math

    total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    costs = {p: round(1e6 * (math.log(r + 2.7) + total)) for r, p in enumerate(pieces)}
    tokens = {"hello", " helloworld", "hell", "zzzzzz", "éàé", " the"}
    counter.learn(tokens)
    for t in tokens:
        data = t.encode()
        best = [(0, 0)]
        for end in range(1, len(data) + 1):
            best.append(min((best[k][0] + costs[data[k:end]], best[k][1] + 1) for k in range(end) if data[k:end] in costs))
        assert counter.known[t] == best[-1][1]
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[3].n_tokens > 0
    assert token_counts.token_counts(empty).count() == 0


def test_pipeline(spark, monkeypatch):
    import os

    import corpus_pipeline

    gone, discard = [], corpus_pipeline.discard
    monkeypatch.setattr(corpus_pipeline, "discard", lambda *t: (gone.extend(x._tabkit_path for x in t), discard(*t)))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(gone) == len(corpus_pipeline.STAGES) - 1 and not any(os.path.exists(p.removeprefix("file:")) for p in gone)
    assert os.path.exists(out._tabkit_path.removeprefix("file:"))
    assert out.count() > 100
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No documents at all, and a text of five megabytes."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(720_000))
    rows = [(1, long, "en", "s", 1), (2, "hello world", "en", "s", 1), (3, "ein kurzer Satz", "de", "s", 1)]
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "long/benchmark.parquet"))
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "long/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "long")).groupBy("doc_id").sum("length").collect()
    assert {x[0] for x in got} == {1, 2, 3} and {x[0]: x[1] for x in got}[1] > 1_000_000
