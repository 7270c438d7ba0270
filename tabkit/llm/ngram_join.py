"""N-gram Jaccard join: link documents whose sets of word shingles are alike.

Method: shingles are hashed into groups and a set is a point of group counts.
The sum over groups of the smaller of two counts bounds two sets' overlap, so
an R-tree of points, whose nodes keep upper corners and ranges of set sizes,
finds for a set those that could overlap enough.  All candidate pairs come
from such trees; they are then verified on the sets themselves.

Spread over a cluster, alike sets are brought together by keys: the first
shingles of a set, rare ones first, taken so many that two alike sets share
one.  Sets that share a key and whose sizes allow a link are connected, and a
component of them is dealt to one *unit*.  A task builds R-trees over its
units, verifies in place, and gives only links that join what was apart, so
its output is linear in the sets it reads, whatever the size of a group.

A component of more than ``SETS`` sets, such as one that shared passages hold
together, is first parted by points alone: R-trees over pairs of blocks of it,
or over its keys' lists, whichever moves fewer points, give the pairs that
could be alike, and their components take its place.  One that is still larger
is cut into blocks, each a unit; then the sets outside the commonest part found
so far meet all the others, block by block.  Pairs of sets that are both in
the commonest part are linked already.

Defined results: a null text or one without words has an empty set, links to
nothing and is its own component; a text of fewer words than a shingle has one
shingle of all its words; equal sets are one node, and so are rows that share a
doc_id; a row without doc_id links as others do and has the component of what
it links to, or null; a very long text is one row, so a task holds its hashes
(8 bytes a word); ties and repeated rows cannot change components; an empty
table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, has
from .frames import discard, hot_join, partitions, plain_names, texts, written
from .graph import components
from .textbytes import SPACE_WORD, Texts, Words, mix, shingles, signed, texts_of

WORDS = 5
PERCENT = 80
#: Groups of a point.
GROUPS = 2048
#: Children of a node of an R-tree.
FAN = 8
#: Points that go down an R-tree together, and pairs of points and nodes that are compared at a time.
TOGETHER, PAIRS = 64, 64
#: Sets and shingles of a unit at most; an R-tree holds several units of fewer than ``SOME`` sets.
SETS, SHINGLES, SOME = 1024, 1 << 22, 256
#: Sets of a block of what is larger.
BLOCK = 128
#: Length of the list of frequent shingles, which only sets the order of keys.
FREQUENT = 1 << 16


class Sets:
    """Distinct shingles of some texts, sorted by text: ``doc``, ``hash``; ``size`` and ``mark`` of each text's set."""

    def __init__(self, texts_: Texts, words: int):
        w = Words(texts_, SPACE_WORD, True)
        n = np.diff(w.off)
        number = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        self.doc = np.repeat(np.arange(len(n)), number)
        start = w.off[self.doc] + np.arange(len(self.doc)) - np.repeat(np.cumsum(number) - number, number)
        self.hash = shingles(w.hashes(), start, np.minimum(n, words)[self.doc])
        by = np.lexsort((self.hash, self.doc))
        self.doc, self.hash = self.doc[by], self.hash[by]
        new = np.ones(len(by), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.hash[1:] != self.hash[:-1])
        self.doc, self.hash = self.doc[new], self.hash[new]
        self.size = np.bincount(self.doc, minlength=len(n))
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.hash + np.uint64(77)))))
        self.mark = signed(mix(total[self.off[1:]] - total[self.off[:-1]] + self.size.astype(np.uint64)))


def _members(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts_of(b.column("text")):
                s = Sets(t, words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, len(t)), pa.array(s.size), pa.array(s.mark)], ["doc_id", "n", "mark"])

    return work


def _first_of_mark(s: Sets) -> np.ndarray:
    """Texts of a slice that are the first with their set."""
    keep = np.zeros(len(s.size), bool)
    keep[np.unique(s.mark, return_index=True)[1]] = True
    return keep & (s.size > 0)


def _frequent(words: int):
    def work(batches):
        for b in batches:
            for t in texts_of(b.column("text")):
                s = Sets(t, words)
                value, n = np.unique(s.hash[_first_of_mark(s)[s.doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(value[n > 1])), pa.array(n[n > 1])], ["hash", "n"])

    return work


def _keys(words: int, percent: int, frequent):
    """Rows of key, n, mark: the first shingles of each distinct set."""

    def work(batches):
        seen: set[int] = set()
        common, tier = frequent.value
        for b in batches:
            for t in texts_of(b.column("text")):
                s = Sets(t, words)
                use = _first_of_mark(s)
                for i in np.flatnonzero(use):
                    if (m := int(s.mark[i])) in seen:
                        use[i] = False
                    elif len(seen) < 500_000:
                        seen.add(m)
                pick = use[s.doc]
                doc, h = s.doc[pick], s.hash[pick]
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                rank = (h >> np.uint64(4)) | (np.where(common[at] == h, tier[at], 0).astype(np.uint64) << np.uint64(60))
                by = np.lexsort((rank, doc))
                doc, rank = doc[by], rank[by]
                size = np.where(use, s.size, 0)
                within = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                n = s.size[doc]
                first = within <= n - -(-percent * n // 100)
                yield pa.RecordBatch.from_arrays([pa.array(signed(rank[first])), pa.array(n[first]), pa.array(s.mark[doc[first]])], ["key", "n", "mark"])

    return work


def _shared_keys(percent: int):
    """Of rows sorted by key, n, mark: those with others of the same key whose sizes allow a link, with the first of these.

    Sizes allow a link of any two neighbours, so what a row's list leaves out it cannot link to.
    """
    names = ["key", "n", "mark", "lead"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = lead = None  # the row held back, as it may be alone, and the first mark of its list
        for b in batches:
            rows = np.stack([b.column(k).to_numpy() for k in names[:3]])
            if last is not None:
                rows = np.concatenate((last[:, None], rows), axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, new]
            if not rows.shape[1]:
                continue
            key, n, mark = rows
            head = np.concatenate(([True], (key[1:] != key[:-1]) | (percent * n[1:] > 100 * n[:-1])))
            at = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            first = mark[at]
            alone = head & np.append(head[1:], True)
            if last is not None:
                first[at == 0] = lead
                alone[0] &= lead == mark[0]
            out = ~alone
            out[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (*rows, first)], names)
            last, lead = rows[:, -1], first[-1]
        if last is not None and lead != last[2]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, lead)], names)

    return work


def _hashes(words: int):
    """mark, size and the sorted hashes of each distinct set of a slice."""

    def work(batches):
        for b in batches:
            for t in texts_of(b.column("text")):
                s = Sets(t, words)
                ok = np.flatnonzero(_first_of_mark(s))
                yield pa.RecordBatch.from_arrays([pa.array(s.mark[ok]), pa.array(s.size[ok]), pa.array([s.hash[s.off[i] : s.off[i + 1]].tobytes() for i in ok], pa.binary())], ["mark", "n", "body"])

    return work


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """The points of sets of hashes."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    group = (np.concatenate(sets) >> np.uint64(53)).astype(np.int64)
    counts = np.bincount(of * GROUPS + group, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS)
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int64)


def packed(counts: np.ndarray) -> bytes:
    """A point in half a byte a group; what is above 15 adds up to one more coordinate, whose minimum bounds what it hides."""
    low = np.minimum(counts, 15).astype(np.uint8)
    return (low[::2] | low[1::2] << 4).tobytes() + int(counts.sum() - low.sum(dtype=np.int64)).to_bytes(8, "little")


def unpacked(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), GROUPS // 2 + 8)
    above = np.ascontiguousarray(raw[:, GROUPS // 2 :]).view("<i8")
    out = np.empty((len(rows), GROUPS + 1), np.uint16 if above.max(initial=0) < 1 << 16 else np.int64)
    out[:, :GROUPS:2], out[:, 1:GROUPS:2] = raw[:, : GROUPS // 2] & 15, raw[:, : GROUPS // 2] >> 4
    out[:, GROUPS:] = above
    return out


def _points(words: int):
    """mark, size and packed point of each distinct set of a slice."""

    def work(batches):
        for b in _hashes(words)(batches):
            bodies = [packed(_counts([np.frombuffer(x, np.uint64)])[0]) for x in b.column("body").to_pylist()]
            yield b.set_column(2, "body", pa.array(bodies, pa.binary()))

    return work


class RTree:
    """A packed R-tree of points of counts; nodes keep upper corners and ranges of set sizes.  ``visited`` counts nodes looked at, by level from the leaves."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.levels = [(points, n, n)]
        while len(self.levels[-1][0]) > FAN:
            upper, low, high = self.levels[-1]
            at = np.arange(0, len(upper), FAN)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        self.visited = [0] * len(self.levels)
        #: No sum of minima is above a point's own sum.
        self.kind = np.uint16 if points.dtype == np.uint16 and points.sum(axis=1, dtype=np.int64).max(initial=0) < 1 << 16 else np.int64

    def before(self, q: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The points before q whose summed minima with it allow the overlap that is needed, and how much they have to spare."""
        return next(self.all_before(q, q + 1, percent))

    def all_before(self, first: int, end: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``before`` of each point of a range; they go down the tree together."""
        points, n, _ = self.levels[0]
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(first, end), top), np.tile(np.arange(top), end - first)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[depth]
            size, least = n[q], low[node]
            ok = (node <= q // FAN**depth if depth else node < q) & (100 * high[node] >= percent * size) & (percent * least <= 100 * size)
            q, node, size, least = q[ok], node[ok], size[ok], least[ok]
            self.visited[depth] += len(node)
            spare = self._minima(upper, node, q) - _needed(size, np.maximum(least, -(-percent * size // 100)), percent)
            ok = spare >= 0
            q, node, spare = q[ok], node[ok], spare[ok]
            if depth:
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                ok = node < len(self.levels[depth - 1][0])
                q, node = q[ok], node[ok]
        at = np.searchsorted(q, np.arange(first, end + 1))
        for a, z in zip(at[:-1], at[1:], strict=True):
            yield node[a:z], spare[a:z]

    def _minima(self, upper: np.ndarray, node: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The summed minima of some nodes' corners and points, a few at a time that fit a cache."""
        points, out = self.levels[0][0], np.empty(len(node), np.int64)
        for i in range(0, len(node), PAIRS):
            own = points[q[i : i + PAIRS]]
            np.minimum(own, upper[node[i : i + PAIRS]], out=own)
            out[i : i + PAIRS] = own.sum(axis=1, dtype=self.kind)
        return out


def _needed(n, m, percent: int):
    """The least overlap of alike sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def links(points: np.ndarray, n: np.ndarray, part: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs that connect what is alike and was in different parts: at most one less than sets.

    Alike are sets whose points allow it and, if the sets are given, that are
    so themselves.  Neighbours are likely alike.
    """
    tree = RTree(points, n)
    above = np.unique(part, return_index=True)[1][np.unique(part, return_inverse=True)[1]]  # a union-find forest

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    found = chain.from_iterable(tree.all_before(i, min(i + TOGETHER, len(n)), percent) for i in range(0, len(n), TOGETHER))
    for q, (near, spare) in enumerate(found):
        near = near[np.argsort(-spare, kind="stable")]
        for at in range(0, len(near), 16):  # the likeliest first, as they may settle the others
            some = [p for p in near[at : at + 16].tolist() if root(p) != root(q)]
            if not some:
                continue
            if sets:
                other = np.concatenate([sets[p] for p in some])
                found = sets[q][np.minimum(np.searchsorted(sets[q], other), n[q] - 1)] == other
                same = np.add.reduceat(found, np.cumsum([0, *n[some][:-1]]), dtype=np.int64)
                some = [p for p, k in zip(some, same.tolist(), strict=True) if 100 * k >= percent * (n[p] + n[q] - k)]
            for p in some:
                if root(p) != root(q):
                    above[root(p)] = root(q)
                    yield p, q


def _linked(percent: int, by_sets: bool):
    """Rows of unit, mark, part, n, body (hashes of sets, or points), sorted by unit: links between different parts, of some units together."""

    def block(kept: list[pa.RecordBatch]):
        t = pa.Table.from_batches(kept)
        one = np.sort(np.unique(t["mark"].to_numpy(), return_index=True)[1])
        mark, unit, part, n = (t[k].to_numpy()[one] for k in ("mark", "unit", "part", "n"))
        bodies = t["body"].take(one).to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in bodies] if by_sets else None
        by = np.lexsort(([int(x[0]) >> 1 for x in sets] if by_sets else n, unit))
        sets = [sets[i] for i in by] if by_sets else None
        points = _counts(sets) if by_sets else unpacked([bodies[i] for i in by])
        found = list(links(points, n[by], part[by], percent, sets))
        if found:
            a, b = mark[by][np.array(found).T]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def work(batches):
        kept, rows, size = [], 0, 0
        for b in batches:
            while len(b):
                unit = b.column("unit").to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1))
                if kept and kept[-1].column("unit")[-1].as_py() == unit[0]:
                    cuts = cuts[1:]
                total = np.concatenate(([0], np.cumsum(b.column("n").to_numpy())))
                over = cuts[(rows + cuts >= SOME) | (size + total[cuts] >= SHINGLES)]
                if len(over) and rows + over[0]:
                    z = int(over[0])
                    yield from block([*kept, b.slice(0, z)])
                    kept, rows, size, b = [], 0, 0, b.slice(z)
                else:
                    kept.append(b)
                    rows, size = rows + len(b), size + int(total[-1])
                    break
        if kept:
            yield from block(kept)

    return work


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links, of each row."""
    spark, docs, shuffles = docs.sparkSession, texts(docs), partitions(docs)
    members = written(docs.mapInArrow(_members(words), "doc_id long, n long, mark long"))

    got = docs.mapInArrow(_frequent(words), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 7").orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    common, times = got["hash"].to_numpy().view(np.uint64), got["n"].to_numpy()
    by = np.argsort(common)
    tier = np.minimum(15, np.log2(np.maximum(times, 2)).astype(int))
    frequent = spark.sparkContext.broadcast((np.append(common[by], np.uint64(0)) if not len(by) else common[by], np.append(tier[by], 0) if not len(by) else tier[by]))

    keys = docs.mapInArrow(_keys(words, percent, frequent), "key long, n long, mark long").repartition(shuffles, "key").sortWithinPartitions("key", "n", "mark")
    shared = written(keys.mapInArrow(_shared_keys(percent), "key long, n long, mark long, lead long"))
    del keys

    near = components(shared.select(F.col("lead").alias("a"), F.col("mark").alias("b")))
    nodes = written(shared.select("mark", "n").distinct().join(near.toDF("mark", "label"), "mark"))
    discard(near)
    holders = members.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    holders = written(nodes.select("mark").join(holders, "mark", "left"))

    def linked(units: DataFrame, by_sets: bool, whose: DataFrame) -> DataFrame:
        """Links between the sets, or the points, of each unit (unit, mark, part); they are made of one row a set."""
        held = spark.sparkContext.broadcast(bloom(whose, "doc_id"))

        def holds(batches):
            for b in batches:
                ids = b.column("doc_id")
                yield b.filter(pa.array(has(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)))

        bodies = docs.mapInArrow(holds, docs.schema).mapInArrow((_hashes if by_sets else _points)(words), "mark long, n long, body binary")
        bodies = bodies.join(whose.select("mark"), "mark", "left_semi").groupBy("mark").agg(F.first("n").alias("n"), F.first("body").alias("body"))
        rows = units.join(bodies, "mark").select("unit", "mark", "part", "n", "body")
        return written(rows.repartition(shuffles, "unit").sortWithinPartitions("unit").mapInArrow(_linked(percent, by_sets), "a long, b long"))

    sizes = written(_sized(nodes))
    large = written(hot_join(nodes, sizes.where("times > 1").select("label"), "label"))
    if not large.isEmpty():
        near = components(linked(_pairs_of_blocks(shared, large, sizes), False, holders.join(large.select("mark"), "mark")))
        parted = hot_join(nodes, sizes.where("times = 1").select("label"), "label").select("mark", "n", "label")
        nodes = written(parted.union(large.select("mark", "n").join(near.toDF("mark", "label"), "mark").select("mark", "n", "label")))
        sizes = written(_sized(nodes))
        holders = written(holders.join(nodes.select("mark"), "mark", "left_semi"))
    groups = hot_join(nodes, sizes, "label").select(F.col("label").alias("group"), "mark", F.when(F.col("times") > 1, F.col("blocks")).otherwise(1).alias("blocks"))
    groups = written(groups.withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks"))))
    each = groups.select(F.when(F.col("blocks") > 1, F.xxhash64("group", "block")).otherwise(F.col("group")).alias("unit"), "mark", F.col("mark").alias("part"))
    edges = linked(each, True, holders).union(_same_rows(members))
    labels = components(edges)
    split = groups.where("blocks > 1")
    if not split.isEmpty():
        across = written(_across(split, labels))
        edges = edges.union(linked(across, True, holders.join(across.select("mark").distinct(), "mark", "left_semi")))
        labels = components(edges)
    return _with_components(members, labels)


def _sized(nodes: DataFrame) -> DataFrame:
    """label, sets, size, times (units needed) and blocks of each component of nodes (mark, n, label)."""
    out = nodes.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    out = out.withColumn("times", F.ceil(F.greatest(F.col("sets") / SETS, F.col("size") / SHINGLES)).cast("long"))
    return out.withColumn("blocks", F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("size") / (SHINGLES / 4))).cast("long"))


def _pairs_of_blocks(shared: DataFrame, large: DataFrame, sizes: DataFrame) -> DataFrame:
    """Units (unit, mark, part) in which every two sets of a large component that share a key, and may be alike by size, meet."""
    own = written(shared.select(F.xxhash64("key", "lead").alias("list"), "mark").join(large, "mark"))
    # lists of the same sets (a passage has many) are one
    lists = own.groupBy("list").agg(F.first("label").alias("label"), F.count("*").alias("sets"), F.expr("bit_xor(mark)").alias("x"), F.expr("bit_xor(xxhash64(mark))").alias("y"))
    lists = lists.groupBy("sets", "x", "y").agg(F.min("list").alias("list"), F.first("label").alias("label")).withColumn("blocks", F.when(F.col("sets") > 2 * BLOCK, F.ceil(F.col("sets") / BLOCK)).otherwise(1).cast("long"))
    lists = written(lists)
    dearer = lists.groupBy("label").agg(F.sum(F.col("sets") * F.col("blocks")).alias("moved")).join(sizes, "label").where(F.col("moved") > F.col("sets") * F.col("blocks"))
    dearer = written(dearer.select("label", "blocks"))
    by_list = hot_join(own.select("list", "mark"), lists.join(dearer, "label", "left_anti").select("list", "blocks"), "list").select(F.col("list").alias("group"), "mark", "blocks")
    whole = hot_join(large, dearer, "label").select(F.col("label").alias("group"), "mark", "blocks")
    rows = whole.union(by_list).withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "mark", F.col("mark").alias("part"))


def _across(split: DataFrame, labels: DataFrame) -> DataFrame:
    """Units of the groups in several parts: a block of the sets outside the commonest part with a block of all sets."""
    rows = written(split.join(labels.toDF("mark", "label"), "mark", "left").withColumn("part", F.coalesce("label", "mark")).drop("label"))
    most = rows.groupBy("group", "part").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("in_most"))
    most = most.where("n > in_most").withColumn("others", (F.col("n") - F.col("in_most"))).select("group", "most", F.ceil(F.col("others") / BLOCK).cast("long").alias("others"))
    rows = hot_join(rows, most, "group")
    step = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    out = rows.where("part <> most").withColumn("i", F.pmod(F.xxhash64("mark"), F.col("others"))).withColumn("j", step(F.col("blocks").cast("long")))
    all_ = rows.withColumn("j", F.col("block")).withColumn("i", step(F.col("others")))
    pick = [F.xxhash64("group", "i", "j").alias("unit"), "mark", "part"]
    return out.select(*pick).union(all_.select(*pick))


def _same_rows(members: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share a doc_id."""
    least = members.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("z"), F.collect_set("mark").alias("all")).where("a <> z")
    return least.select("a", F.explode("all").alias("b")).where("a <> b")


def _with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of marks or parts that hold a thousandth of all are joined by broadcast, so none gathers in a task."""
    marks = members.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("least")).join(labels.toDF("mark", "label"), "mark", "left").select("mark", F.coalesce("label", "mark").alias("part"), "least")
    marks = written(marks)
    least = marks.groupBy("part").agg(F.min("least").alias("component_id"))
    marks = written(hot_join(marks, least, "part").select("mark", "component_id"))
    rows = hot_join(members.where("n > 0"), marks, "mark").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return rows.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without all but the least doc_id of each component; all columns stay, whatever their names.

    Rows without doc_id and rows without words stay; rows that share a doc_id
    stay or go together; an empty table stays empty.
    """
    linked = ngram_join(docs, words, percent)
    gone = linked.where("component_id < doc_id").select("doc_id").distinct()
    own = plain_names(docs)
    return own.join(gone, "doc_id", "left_anti").select(own.columns).toDF(*docs.columns)
