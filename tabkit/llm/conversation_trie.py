"""Conversation prefix trie: which conversations begin with the same turns, and what sharing them saves.

Method: a turn is known by a 128-bit digest of its role and text, a
conversation by the digests of its turns; equal conversations are merged before
anything else.  Subtries are dealt out by the digest of their first turn, and
tasks build dictionary tries with child pointers and add up their subtrees in an
iterative postorder.  A first turn with more turns below it than a task should
hold is not built there: the turns that all its conversations share are one
*edge*, and what follows is dealt out by the next turn, as often as needed.
Edges are added up from the deepest round to the root.

Conversations may be rebuilt first (``rebuilt``): each takes the first turns of
the first conversation of its block, as when many are continued from one.

Defined results: rows without conv_id are no conversation's; turns come in the
order of ``turn``, null first, ties by the digest of role and text; a null role
or text is an empty one; repeated rows are turns of their own; a very long text
is one digest, a long conversation one row of 36 bytes a turn; a conversation
without turns ends at the root; an empty table gives an empty one; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, written

#: Bytes of a turn's digest.
KEY = 16
#: Turns below one first turn, beyond which a subtrie is dealt out by its next turn.
LIMIT = 100_000
#: Members of one conversation whose ids are joined in one row; beyond that they are hashed as a sorted stream.
MEMBERS = 10_000
CHUNK = 1 << 20
NOBODY = hashlib.sha256(b"").hexdigest()

_NODE = "under binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: structs of turn, digest (hex) and code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation c - c % block; h is crc32 of its id's digits, modulo ``heads``.

    At most ``2 * block`` conversations have one such base, so the join has no hot key.
    """
    lists = written(lists)
    base = lists.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return own.select("conv_id", turns.alias("turns"))


def _hashed(batches):
    """The SHA-256 of each conversation's chunks, which come in order: a running hash, whatever their number."""
    last, h = None, None
    out = []
    for b in batches:
        for key, text in zip(b.column("seq").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if key != last:
                if h is not None:
                    out.append((last, h.hexdigest()))
                last, h = key, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["seq", "ends"])
            out = []
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["seq", "ends"])


def _chunks(batches):
    """Sorted ids of one conversation, joined in chunks."""
    for b in batches:
        keys, ids = b.column("seq").to_pylist(), b.column("conv_id").to_pylist()
        rows, start = [], 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                rows.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["seq", "first", "ids"])


def _distinct(lists: DataFrame, members: int) -> DataFrame:
    """Distinct turn sequences: path (the digests), sizes, conv_id (the least), n, and the digest of the ids that have it."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    all_ = lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    all_ = written(all_.withColumn("seq", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * KEY))))
    each = written(all_.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.first("sizes").alias("sizes")))
    some = all_.select("seq", "conv_id").join(each.where(f"n > 1 and n <= {members}").select("seq"), "seq")
    ends = some.groupBy("seq").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ","), 256).alias("ends"))
    many = each.where(f"n > {members}").select("seq")
    if not many.isEmpty():
        shuffles = partitions(lists)
        sorted_ = all_.select("seq", "conv_id").join(many, "seq").repartitionByRange(shuffles, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
        chunks = sorted_.mapInArrow(_chunks, "seq binary, first long, ids string")
        ends = ends.unionByName(chunks.repartition(shuffles, "seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "seq binary, ends string"))
    own = each.join(ends, "seq", "left")
    return written(own.select("path", "sizes", "conv_id", "n", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends")))


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of some first turns."""
    tops: dict[tuple[bytes, bytes], int] = {}
    child: list[dict[bytes, int] | None] = []
    conv, depth, parent, n, size, ends = [], [], [], [], [], []
    under: dict[int, tuple[bytes, int]] = {}
    for above, above_conv, start, path, sizes, who, many, mark in zip(*(rows[c] for c in ("under", "parent_conv", "depth", "path", "sizes", "conv_id", "n", "ends")), strict=True):
        path, node = bytes(path), -1
        for d in range(start, len(path) // KEY):
            key = path[d * KEY : (d + 1) * KEY]
            if node < 0:
                below, key = tops, (bytes(above), key)
            else:
                below = child[node]
                if below is None:
                    below = child[node] = {}
            at = below.get(key)
            if at is None:
                at = below[key] = len(child)
                if node < 0:
                    under[at] = (bytes(above), above_conv)
                child.append(None)
                conv.append(who)
                depth.append(d + 1)
                parent.append(node)
                n.append(many)
                size.append(int(sizes[d]))
                ends.append(None)
            else:
                n[at] += many
                if who < conv[at]:
                    conv[at] = who
            node = at
        ends[node] = mark
    leaves, saved = [0] * len(child), [0] * len(child)
    for top in tops.values():
        stack = [(top, iter((child[top] or {}).values()))]
        while stack:
            node, rest = stack[-1]
            if (below := next(rest, None)) is not None:
                stack.append((below, iter((child[below] or {}).values())))
                continue
            stack.pop()
            saved[node] += (n[node] - 1) * size[node]
            leaves[node] += child[node] is None
            if stack:
                saved[stack[-1][0]] += saved[node]
                leaves[stack[-1][0]] += leaves[node]
    nodes = range(len(child))
    return pd.DataFrame({
        "under": [under[i][0] if i in under else None for i in nodes], "top": [i in under for i in nodes], "conv_id": conv, "depth": depth,
        "parent_conv_id": [under[i][1] if i in under else conv[parent[i]] for i in nodes], "n_convs": n, "n_children": [len(child[i] or ()) for i in nodes],
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [e or NOBODY for e in ends],
    })


def _shared_to(batches):
    """How many turns the least and the greatest path of a group share, which all between them share too."""
    for b in batches:
        to = []
        for a, z in zip(b.column("least").to_pylist(), b.column("greatest").to_pylist(), strict=True):
            k = min(len(a), len(z))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, k) != np.frombuffer(z, np.uint8, k))
            to.append((int(differ[0]) if len(differ) else k) // KEY)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32())], [*b.schema.names, "to"])


def _edge_nodes(batches):
    """A node for each turn of an edge."""
    for b in batches:
        for r in b.to_pylist():
            size = np.array(r["sizes"], np.int64)
            k = len(size)
            saved = np.cumsum(((r["n"] - 1) * size)[::-1])[::-1] + r["saved"]
            one, many = pa.array(np.ones(k, np.int64)), lambda v, k=k: pa.array(np.full(k, v, np.int64))
            children, parents = np.ones(k, np.int64), np.full(k, r["conv_id"], np.int64)
            children[-1], parents[0] = r["children"], r["parent_conv"]
            ends = [NOBODY] * (k - 1) + [r["ends"] or NOBODY]
            yield pa.RecordBatch.from_arrays([many(r["conv_id"]), pa.array(np.arange(k) + r["depth"] + 1), pa.array(parents), many(r["n"]), pa.array(children), many(r["leaves"]) if r["leaves"] != 1 else one, pa.array(saved), pa.array(ends)], _COLUMNS)


def prefix_trie(lists: DataFrame, limit: int = LIMIT, members: int = MEMBERS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns), the root included."""
    spark, shuffles = lists.sparkSession, partitions(lists)
    each = _distinct(lists, members)
    none = spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _COLUMNS))
    whole = each.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.size("sizes")).alias("turns"), F.max(F.when(F.size("sizes") == 0, F.col("ends"))).alias("ends")).first()
    if whole.n is None:
        return none
    buckets = max(2 * shuffles, math.ceil(whole.turns / limit))
    # a fair share of the tasks, if that is less, so that small tables are spread too
    limit = min(limit, max(500, whole.turns // buckets))
    root = F.lit(b"").cast("binary")
    open_ = each.where(F.size("sizes") > 0).select(root.alias("under"), F.lit(whole.conv_id).cast("long").alias("parent_conv"), F.lit(0).alias("depth"), "path", "sizes", "conv_id", "n", "ends")
    first = F.substring("path", F.col("depth") * KEY + 1, KEY)
    parts, edges = [], []
    while True:
        open_ = open_.withColumn("first", first)
        left = F.sum(F.size("sizes") - F.col("depth"))
        hot = written(open_.groupBy("under", "first").agg(left.alias("turns")).where(F.col("turns") > limit).select("under", "first"))
        cool = open_
        if any_hot := not hot.isEmpty():
            cool = open_.join(hot, ["under", "first"], "left_anti")
        bucket = F.pmod(F.xxhash64("under", "first"), F.lit(buckets))
        parts.append(cool.select("under", "parent_conv", "depth", "path", "sizes", "conv_id", "n", "ends", bucket.alias("bucket")))
        if not any_hot:
            break
        of = open_.join(hot, ["under", "first"])
        edge = of.groupBy("under", "first").agg(F.first("parent_conv").alias("parent_conv"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min("path").alias("least"), F.max("path").alias("greatest"), F.min_by("sizes", "path").alias("sizes"), F.min_by("ends", "path").alias("ends"))
        edge = edge.select(*edge.columns).mapInArrow(_shared_to, "under binary, first binary, parent_conv long, depth int, n long, conv_id long, least binary, greatest binary, sizes array<long>, ends string, to int")
        key = F.unhex(F.substring(F.sha2(F.concat("under", F.substring("least", F.lit(1), F.col("to") * KEY)), 256), 1, 2 * KEY))
        ends = F.when(F.octet_length("least") == F.col("to") * KEY, F.col("ends"))
        edge = written(edge.select("under", "first", "parent_conv", "depth", "to", "n", "conv_id", F.slice("sizes", F.col("depth") + 1, F.col("to") - F.col("depth")).alias("sizes"), ends.alias("ends"), key.alias("key")))
        edges.append(edge)
        below = of.drop("parent_conv", "depth").join(edge.select("under", "first", F.col("key"), F.col("conv_id").alias("parent_conv"), F.col("to").alias("depth")), ["under", "first"])
        open_ = written(below.where(F.size("sizes") > F.col("depth")).select(F.col("key").alias("under"), "parent_conv", "depth", "path", "sizes", "conv_id", "n", "ends"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    nodes = written(rows.groupBy("bucket").applyInPandas(lambda pdf: _tries(pdf), _NODE))
    sums = nodes.where("top").groupBy("under").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    done = none
    for edge in reversed(edges):
        own = edge.join(sums.withColumnRenamed("under", "key"), "key", "left").select("under", "parent_conv", "depth", "n", "conv_id", "sizes", "ends", *(F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in (("children", 0), ("leaves", 1), ("saved", 0))))
        own = written(own)
        done = done.unionByName(own.mapInArrow(_edge_nodes, none.schema))
        here = F.col("saved") + (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
        sums = written(sums.unionByName(own.select("under", F.lit(1).cast("long").alias("children"), "leaves", here.alias("saved"))).groupBy("under").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))))
    top = sums.where(F.col("under") == root).first()
    children, leaves, saved = (top.children, top.leaves, top.saved) if top else (0, 1, 0)
    root_row = spark.createDataFrame([(whole.conv_id, 0, None, whole.n, children, leaves, saved, whole.ends or NOBODY)], none.schema)
    return nodes.select(*_COLUMNS).unionByName(done).unionByName(root_row)


def conversation_trie(conversations: DataFrame, block: int = 100, heads: int = 6, limit: int = LIMIT, members: int = MEMBERS) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(turn_lists(conversations), block, heads), limit, members)
