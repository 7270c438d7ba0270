"""Benchmark decontamination: find benchmark windows in documents with a suffix automaton.

Method: the words of all benchmark items make one generalised suffix
automaton.  A document's words are streamed through it; the state and the
length matched so far tell which windows end at each word.  Words that no item
has break every match, so only runs of known words are streamed.

The benchmark is broadcast in blocks of about ``BLOCK_BYTES`` of text, whose
automaton takes about a hundred times that in a worker.  With a larger
benchmark the texts are read once for each block, by tasks that hold one
automaton; only what is found is written, by the text's digest, and joined back.
The corpus is never written again, and shuffled once if what is found is more
than Spark broadcasts.

Defined results: a null or empty text has no words and is clean; an item of
fewer words than a window is one window, an item of none has none; repeated
items count once; items without item_id hit words and are not counted; a very
long text is one row, whose words a task holds; ties cannot change results; an
empty table of documents gives an empty one, an empty benchmark hits nothing;
other columns, whatever their names, are ignored or carried along.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, plain_names, small_batches, texts, written
from .textbytes import ALNUM_WORD, LOWER, Words, covered, texts_of

WINDOW = 13
#: A document is contaminated from this share of its words on: 1 in 20.
SHARE = 20
BLOCK_BYTES = 1 << 20
#: Blocks that one job scans; their items pass the driver together.
AT_ONCE = 16

_FOLD = bytes(int(LOWER[i]) if ALNUM_WORD[i] else 0x20 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            coded.append((item, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        own: dict[int, dict[int, set]] = {}
        self.shortest = window
        for item, ids in coded:
            size = min(window, len(ids))
            if not size:
                continue
            self.shortest = min(self.shortest, size)
            state, length = 0, 0
            for i, c in enumerate(ids):
                state, length = self.step(state, length, c)
                while state and self.length[self.link[state]] >= size:
                    state = self.link[state]
                    length = self.length[state]
                if length >= size and i >= size - 1:
                    own.setdefault(state, {}).setdefault(size, set()).add(item)
        # windows of a state's shorter suffixes end where it does
        self.windows: list[tuple] = [()] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.windows[v] = tuple((n, frozenset(x)) for n, x in own.get(v, {}).items()) + self.windows[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """Starts and ends of the windows found, and their items."""
        starts, ends, items = [], [], set()
        get = self.vocabulary.get
        known = np.array([get(w, 0) for w in words], np.int64)
        d = np.diff(np.concatenate(([0], (known > 0).astype(np.int8), [0])))
        for a, z in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True):
            if z - a < self.shortest:
                continue
            state = length = 0
            for i, c in enumerate(known[a:z].tolist(), a + 1):
                state, length = self.step(state, length, c)
                for n, which in self.windows[state]:
                    if n <= length:
                        starts.append(i - n)
                        ends.append(i)
                        items |= which
        return starts, ends, items


def _scan(block, window: int, names: list[str]):
    """Append what one block of items hits to the columns starts, ends and items."""

    def work(batches):
        automaton = SuffixAutomaton([(i, words_of(t.encode())) for i, t in block.value], window)
        for b in batches:
            for t in texts_of(b.column("text")):
                part = b.slice(t.first, len(t))
                old = [part.column(k).to_pylist() for k in ("starts", "ends", "items")]
                n = []
                for i in range(len(t)):
                    words = words_of(t.bytes(i))
                    n.append(len(words))
                    starts, ends, items = automaton.scan(words)
                    old[0][i] += starts
                    old[1][i] += ends
                    old[2][i] += [x for x in items if x is not None]
                columns = [part.column(k) for k in names] + [pa.array(n, pa.int64())] + [pa.array(x, pa.list_(pa.int64())) for x in old]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "starts", "ends", "items"])

    return work


def _found(block, number: int, window: int):
    """Of each text that the block hits: what ``_scan`` finds."""

    def work(batches):
        automaton = SuffixAutomaton([(i, words_of(t.encode())) for i, t in block.value], window)
        for b in batches:
            for t in texts_of(b.column("text")):
                keys, rows = b.column("__key").slice(t.first, len(t)).to_pylist(), []
                for i in range(len(t)):
                    starts, ends, items = automaton.scan(words_of(t.bytes(i)))
                    if starts:
                        rows.append((keys[i], number, starts, ends, [x for x in items if x is not None]))
                if rows:
                    kinds = [pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["__key", "block", "starts", "ends", "items"])

    return work


def _counted(names: list[str]):
    """Put n_words beside the columns."""

    def work(batches):
        for b in batches:
            n = [len(words_of(t.bytes(i))) for t in texts_of(b.column("text")) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(n, pa.int64()), *(b.column(k) for k in ("starts", "ends", "items"))], [*names, "n_words", "starts", "ends", "items"])

    return work


def _by_blocks(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    spark, names = docs.sparkSession, docs.columns
    keyed = docs.withColumn("__key", F.coalesce(F.sha2("text", 256), F.col("doc_id").cast("string")))
    some = keyed.where("text is not null").select("__key", "text")
    tables = []
    for first in range(0, blocks, AT_ONCE):
        sent, parts = [], []
        for k in range(first, min(first + AT_ONCE, blocks)):
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
            sent.append(spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows]))
            parts.append(some.mapInArrow(_found(sent[-1], k, window), "__key string, block int, starts array<bigint>, ends array<bigint>, items array<bigint>"))
        # copies of a text are hit alike: one row a text and block, merged before any shuffle
        found = reduce(DataFrame.unionAll, parts).groupBy("__key", "block").agg(*(F.first(c).alias(c) for c in ("starts", "ends", "items")))
        tables.append(written(found))
        for x in sent:
            x.unpersist()
    found = reduce(DataFrame.unionAll, tables).groupBy("__key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    found = written(found)
    discard(*tables)
    empty = F.array().cast("array<bigint>")
    both = keyed.join(found, "__key", "left").select(*(F.col(f"`{c}`") for c in names), *(F.coalesce(c, empty).alias(c) for c in ("starts", "ends", "items")))
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), *(empty.alias(c) for c in ("starts", "ends", "items"))).schema
    return both.mapInArrow(_counted(names), schema)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with n_words and the starts, ends and items of all windows found."""
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        return _by_blocks(docs, items, blocks, window)
    empty = F.array().cast("array<bigint>")
    found = docs.select(*(F.col(f"`{c}`") for c in names), F.lit(0).cast("long").alias("n_words"), empty.alias("starts"), empty.alias("ends"), empty.alias("items"))
    block = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
    return found.mapInArrow(_scan(block, window, names), found.schema)


def _judged(batches):
    for b in batches:
        n, starts, ends, items = (b.column(k).to_pylist() for k in ("n_words", "starts", "ends", "items"))
        hit = [int(covered(k, np.array(s), np.array(e)).sum()) if s else 0 for k, s, e in zip(n, starts, ends, strict=True)]
        which = [sorted(map(str, set(x))) for x in items]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in which], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in which]), pa.array([h > 0 and SHARE * h >= k for h, k in zip(hit, n, strict=True)], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return scanned(texts(docs), benchmark, window).mapInArrow(_judged, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """The documents without contaminated ones, or with ``cut`` without the words hit in those."""
    given, docs = docs.columns, plain_names(docs)
    names, schema = docs.columns, docs.schema

    def clean(batches):
        for b in batches:
            n, starts, ends = (b.column(k).to_pylist() for k in ("n_words", "starts", "ends"))
            text, keep = b.column("text").to_pylist(), []
            for t in texts_of(b.column("text")):
                for i in range(t.first, t.first + len(t)):
                    hit = covered(n[i], np.array(starts[i]), np.array(ends[i])) if starts[i] else np.zeros(0, bool)
                    dirty = bool(hit.any()) and SHARE * int(hit.sum()) >= n[i]
                    keep.append(cut or not dirty)
                    if dirty and cut:
                        data = text[i].encode()
                        one = next(texts_of(pa.array([text[i]])))
                        w = Words(one, ALNUM_WORD, True)
                        gone = covered(len(data), w.start[hit], w.end[hit])
                        text[i] = bytes(np.frombuffer(data, np.uint8)[~gone]).decode()
            out = b.select(names)
            yield out.set_column(names.index("text"), "text", pa.array(text, pa.string())).filter(pa.array(keep, pa.bool_()))

    return scanned(docs, benchmark, window).mapInArrow(clean, schema).toDF(*given)
