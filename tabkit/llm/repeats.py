"""Bring all places where a window of W units occurs into one shard, each window once.

A unit is a byte or a word.  Every window has an anchor: the least hash of the
k-grams in it.  A maximal run of windows of one document with one anchor is a
*stretch*.  Equal windows have equal anchors, so routing stretches by anchor
brings equal windows together without shipping a window more than once, and
anchors that occur once in all the corpus drop out before any text is moved.
Stretches are told apart by 128-bit digests of their content.  Equal ones are
merged before the shuffle, so a third of all rows being copies of one text costs
one row a task and stretch.

An anchor that more than ``HOT_ROWS`` distinct stretches have is hot: a common
line is in it, or very many near copies.  Windows with a hot anchor are keyed by
three more least hashes besides.  That cuts their stretches finer, at places
that the content decides, so copies merge in between their differences, and
windows that differ in any of the four k-grams part ways.

The shards then hold distinct contents only, and an index over them (a suffix
array or an FM-index) decides which windows repeat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import bloom, has
from .frames import discard, partitions, written
from .textbytes import SPACE_WORD, Prefix, Texts, Words, byte_values, covered, digests, mix, signed, texts_of

#: Windows of one stretch at most, so that its length and a flag fit a byte.
LONGEST = 127
SHARD_BYTES = 4_000_000
HOT_ROWS = 1000


@dataclass(frozen=True)
class Unit:
    """What windows are made of: ``words`` or bytes, their number in a window, and in an anchor."""

    words: bool
    window: int
    gram: int

    def values(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, Words | None]:
        if self.words:
            w = Words(texts, SPACE_WORD, False)
            return w.hashes(), w.off, w
        return byte_values(texts.data), texts.off, None

    def marks(self, texts: Texts, words: Words | None, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of a digest of the content of some spans; words are joined by one blank."""
        if words is not None:
            data, first, last = words.joined()
            start, end = first[start], last[end - 1]
        else:
            data = texts.data
        raw = data.tobytes()
        out = digests(raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True))
        return out[:, 0].astype(np.uint64), out[:, 1].astype(np.uint64)


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    low, n, reach = grams, len(grams) - width + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[:n], low[width - reach : width - reach + n]) if reach < width else low


class Stretches:
    """The stretches of some texts: text ``doc``, ``start`` in units of the slice, ``windows``, ``anchor``, ``mark`` and ``proof`` of the content.

    ``hot``: a filter of hot anchors; ``only_hot``: leave out the others.
    """

    def __init__(self, texts: Texts, unit: Unit, hot: np.ndarray | None = None, only_hot: bool = False):
        values, self.off, self.words = unit.values(texts)
        n, size = len(values), unit.window
        lengths = np.diff(self.off)
        full = np.flatnonzero(lengths >= size)
        if not len(full):
            self.start = self.windows = self.doc = np.zeros(0, np.int64)
            self.anchor = self.mark = self.proof = np.zeros(0, np.uint64)
            self.twice = np.zeros(0, bool)
            return
        prefix = Prefix(values)
        grams, width = prefix.grams(unit.gram), size - unit.gram + 1
        low = _least(grams, width)
        is_hot = has(hot, signed(low)) if hot is not None else np.zeros(len(low), bool)
        if is_hot.any():
            finer = low.copy()
            for salt in (1, 2, 3):
                finer = mix(finer ^ _least(mix(grams + np.uint64(salt)), width))
            low = np.where(is_hot, finer, low)
        valid = covered(n - size + 1, self.off[full], self.off[full + 1] - size + 1)
        if only_hot:
            valid &= is_hot
        new = valid.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (low[1:] != low[:-1]) | ~valid[1:]
        start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        pieces = -(-(end - start) // LONGEST)
        which = np.repeat(np.arange(len(start)), pieces)
        self.start = start[which] + LONGEST * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        self.windows = np.minimum(end[which] - self.start, LONGEST)
        self.anchor = low[self.start]
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        # a stretch can hold equal windows only if its anchor leaves at the left and the stretch goes on
        left = np.zeros(len(low) + 1, np.int64)
        np.cumsum(((grams[: len(low)] == low) | is_hot)[:-1] & (low[1:] == low[:-1]), out=left[1:-1])
        self.twice = left[self.start + self.windows - 1] > left[self.start]
        self.mark, self.proof = unit.marks(texts, self.words, self.start, self.start + self.windows + size - 1)


def text_tag(text: bytes) -> int:
    """Tells texts apart that have one doc_id."""
    return zlib.crc32(text)


def _found(unit: Unit, hot=None) -> Callable:
    """Distinct stretches of each slice; only those of hot anchors, if these are given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for texts in texts_of(b.column("text")):
                s = Stretches(texts, unit, hot.value, True) if hot else Stretches(texts, unit)
                if not len(s.start):
                    continue
                own = ids[texts.first + s.doc]
                by = np.lexsort((s.start, own, s.proof, s.mark))
                mark, proof, own, start = s.mark[by], s.proof[by], own[by], (s.start - s.off[s.doc])[by]
                head = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (proof[1:] != proof[:-1]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (signed(s.anchor[by][head]), signed(mark[head]), signed(proof[head]), np.diff(np.append(head, len(mark))), own[head], start[head] * 256 + s.twice[by][head] * 128 + s.windows[by][head])],
                    ["anchor", "mark", "proof", "n", "doc_id", "place"],
                )

    return work


def _contents(unit: Unit) -> Callable:
    """The content of each chosen stretch; a row's places are looked up in its text and checked by their marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column("want")
            flat, offsets = want.values, want.offsets.to_numpy()
            place, mark, proof = (flat.field(c).to_numpy() for c in ("place", "mark", "proof"))
            rows = []
            for texts in texts_of(b.column("text")):
                words = Words(texts, SPACE_WORD, False) if unit.words else None
                off = words.off if words else texts.off
                a, z = offsets[texts.first], offsets[texts.first + len(texts)]
                doc = np.repeat(np.arange(len(texts)), np.diff(offsets[texts.first : texts.first + len(texts) + 1]))
                start = off[doc] + place[a:z] // 256
                end = start + place[a:z] % 128 + unit.window - 1
                ok = end <= off[doc + 1]
                same = unit.marks(texts, words, start[ok], end[ok])
                ok[ok] = (signed(same[0]) == mark[a:z][ok]) & (signed(same[1]) == proof[a:z][ok])
                for i in np.flatnonzero(ok):
                    s, e = (words.start[start[i]], words.end[end[i] - 1]) if words else (start[i], end[i])
                    rows.append((a + i, texts.data[s:e].tobytes()))
            if rows:
                take = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([flat.field(k).take(take) for k in ("anchor", "mark", "proof", "n", "least")] + [pa.array([r[1] for r in rows], pa.binary())], ["anchor", "mark", "proof", "n", "least", "content"])

    return work


def _shards(solve: Callable, unit: Unit) -> Callable:
    """Solve rows that are sorted by shard and anchor, in blocks that end between anchors."""

    def block(rows: list) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        mark, proof = t["mark"].to_numpy(), t["proof"].to_numpy()
        by = np.lexsort((proof, mark))
        head = np.sort(by[np.concatenate(([True], (mark[by][1:] != mark[by][:-1]) | (proof[by][1:] != proof[by][:-1])))])
        t = t.take(head)
        where, start, end, in_least = solve(t["content"].to_pylist(), t["n"].to_numpy(), t["least"].to_numpy(), t["anchor"].to_numpy(), unit)
        return pa.RecordBatch.from_arrays([pa.array(mark[head][where]), pa.array(proof[head][where]), pa.array(start), pa.array(end), pa.array(t["least"].to_numpy()[where]), pa.array(in_least)], ["mark", "proof", "first", "last", "least", "in_least"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            while len(b):
                anchors = b.column("anchor").to_numpy()
                lengths = np.cumsum(pc.binary_length(b.column("content")).to_numpy())
                over = int(np.searchsorted(lengths, max(0, SHARD_BYTES - size), "right"))
                cut = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                cut = cut[cut >= max(over, 1)]
                if over >= len(b) or not len(cut):
                    kept.append(b)
                    size += int(lengths[-1])
                    break
                kept.append(b.slice(0, int(cut[0])))
                b = b.slice(int(cut[0]))
                yield block(kept)
                kept, size = [], 0
        if kept:
            yield block(kept)

    return work


def _places(unit: Unit, repeated, hot) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for texts in texts_of(b.column("text")):
                s = Stretches(texts, unit, hot.value if hot else None)
                mark = signed(s.mark)
                at = np.flatnonzero(has(repeated.value, mark))
                if len(at):
                    doc = s.doc[at]
                    tags = np.zeros(len(texts), np.int64)
                    for d in np.unique(doc):
                        tags[d] = text_tag(texts.bytes(d))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark[at], signed(s.proof)[at], ids[texts.first + doc], tags[doc], (s.start - s.off[s.doc])[at])], ["mark", "proof", "doc_id", "tag", "at"])

    return work


def by_row(docs: DataFrame) -> F.Column:
    """doc_id, or a hash of the text in its place; that it may be another's doc_id does no harm, as marks and tags tell."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, unit: Unit, solve: Callable, earlier: bool) -> DataFrame:
    """Runs of repeated windows: row, tag, first, last (units from the text's start; last excluded).

    ``solve`` gets the distinct contents of some anchors, how often each
    stretch occurs, its least doc_id and its anchor, and gives runs of windows
    of them.  ``earlier``: a run counts only in documents after its least one,
    or in that too if ``solve`` says so; rows without doc_id take no part.
    """
    spark, shuffles = docs.sparkSession, partitions(docs)
    docs = docs.where("text is not null and doc_id is not null" if earlier else "text is not null").select(by_row(docs).alias("doc_id"), "text")

    def distinct(hot=None) -> DataFrame:
        found = docs.mapInArrow(_found(unit, hot), "anchor long, mark long, proof long, n long, doc_id long, place long")
        each = found.groupBy("anchor", "mark", "proof").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "place")).alias("rep"))
        own = Window.partitionBy("anchor")
        each = each.withColumn("all", F.sum(F.col("n") + F.col("rep.place").bitwiseAND(128) / 128).over(own)).withColumn("stretches", F.count("*").over(own)).where("all > 1")
        return written(each.select("anchor", "mark", "proof", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.place").alias("place"), "stretches"))

    each, hot = distinct(), None
    many = each.where(F.col("stretches") > HOT_ROWS).select("anchor").distinct()
    if not many.isEmpty():
        hot = spark.sparkContext.broadcast(bloom(written(many), "anchor"))

        def cool(batches):
            for b in batches:
                yield b.filter(pa.array(~has(hot.value, b.column("anchor").to_numpy())))

        each = written(each.mapInArrow(cool, each.schema).unionByName(distinct(hot)))
    # copies of one stretch that shares its anchor with no other are known to repeat as a whole, and nowhere else
    sole = each.where("stretches = 1 and n > 1").select("mark", "proof", F.lit(0).alias("first"), (F.col("place") % 128).cast("int").alias("last"), F.col("doc_id").alias("least"), F.lit(not earlier).alias("in_least"))
    kept, each = each, each.where("stretches > 1" if earlier else "stretches > 1 or n = 1")
    total = each.agg(F.sum(F.col("place") % 128 + unit.window)).first()[0] or 0
    holders = spark.sparkContext.broadcast(bloom(each, "doc_id"))

    def holds(batches):
        for b in batches:
            yield b.filter(pa.array(has(holders.value, b.column("doc_id").to_numpy(zero_copy_only=False))))

    want = each.groupBy("doc_id").agg(F.collect_list(F.struct("place", "mark", "proof", "anchor", "n", F.col("doc_id").alias("least"))).alias("want"))
    contents = docs.mapInArrow(holds, docs.schema).join(want, "doc_id").select("text", "want").mapInArrow(_contents(unit), "anchor long, mark long, proof long, n long, least long, content binary")
    shards = max(1, min(100_000, math.ceil(total * (6 if unit.words else 1) / SHARD_BYTES)), min(shuffles, 48))
    solved = contents.repartition(shards, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(solve, unit), "mark long, proof long, first int, last int, least long, in_least boolean")
    solved = written(solved.union(sole))
    discard(kept)
    repeated = spark.sparkContext.broadcast(bloom(solved, "mark"))
    places = docs.mapInArrow(_places(unit, repeated, hot), "mark long, proof long, doc_id long, tag long, at long")
    hits = places.join(solved, ["mark", "proof"])
    if earlier:
        hits = hits.where("least < doc_id or in_least and least = doc_id")
    return hits.select(F.col("doc_id").alias("row"), "tag", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + (unit.window - 1)).alias("last"))


def cut_documents(docs: DataFrame, spans: DataFrame, cut: Callable, out: str) -> DataFrame:
    """Give ``cut`` each text with the starts and ends of its spans; texts without spans skip the shuffle."""
    spark = docs.sparkSession
    spans = written(spans.groupBy("row", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    holders = spark.sparkContext.broadcast(bloom(spans, "row"))
    names, schema = docs.columns, docs.schema
    docs = docs.withColumn("row", by_row(docs))

    def part(with_spans: bool):
        def work(batches):
            for b in batches:
                some = has(holders.value, b.column("row").to_numpy())
                b = b.filter(pa.array(some if with_spans else ~some))
                if with_spans:
                    tags = [text_tag(t.bytes(i)) for t in texts_of(b.column("text")) for i in range(len(t))]
                    b = pa.RecordBatch.from_arrays([*b.columns, pa.array(tags, pa.int64())], [*names, "row", "tag"])
                    yield b
                else:
                    yield from apply(b.select(names), None)

        return work

    def apply(b, spans_of):
        for texts in texts_of(b.column("text")):
            empty = np.zeros((0, 2), np.int64)
            yield cut(b.slice(texts.first, len(texts)), texts, [empty if spans_of is None else spans_of[texts.first + i] for i in range(len(texts))])

    def joined(batches):
        for b in batches:
            column = b.column("spans")
            spans_of = [np.zeros((0, 2), np.int64) if not column[i].is_valid else np.array([(x["first"], x["last"]) for x in column[i].as_py()], np.int64).reshape(-1, 2) for i in range(len(b))]
            yield from apply(b.select(names), spans_of)

    some = docs.mapInArrow(part(True), T.StructType([*schema, T.StructField("row", T.LongType()), T.StructField("tag", T.LongType())]))
    some = some.join(spans, ["row", "tag"], "left").select(*names, "spans").mapInArrow(joined, out)
    return docs.mapInArrow(part(False), out).unionByName(some)
