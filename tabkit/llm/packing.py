"""Best-fit packing of tokenized documents into sequences of one length.

Method: pieces are placed best fit, longest first, and a local search follows:
documents of underfull bins, the emptiest first, are moved into others or
exchanged one for one, one for two or two for one, wherever the fuller bin gets
fuller (the sum of squared fills rises), until so many bins are empty that no
packing needs fewer, or nothing more can be exchanged.  A document longer than a sequence is cut, its
first piece being the short one.

Pieces are dealt to shards of about ``SHARD`` pieces, which are packed on
their own: a shard wastes a bin or so of some twenty thousand.

Tokens are those of a public byte-pair vocabulary.  They are computed by a
second reader of the same vocabulary which is faster; that both give the same
ids is tested.  Defined results: a null or empty text is the end mark alone;
every row is a document of its own, and equal rows may go anywhere; a very long
text is one row, cut into pieces; an empty table gives an empty one; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import texts, written
from .textbytes import texts_of
from .token_counts import vocabulary

LENGTH = 2048
END = 0
SHARD = 50_000
_DOUBLE_SPACE = re.compile(r"\s\s")


def encoder(pieces: list[bytes], pattern: str, special: dict[str, int]):
    """Text to ids, of the vocabulary's pieces by rank.  Where no two blanks meet, the pattern needs no look-ahead and a faster one does."""
    import tiktoken

    ranks = {piece: r for r, piece in enumerate(pieces)}
    plain = pattern.replace(r"|\s+(?!\S)|\s+", r"|\s")
    slow = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    fast = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens=special)
    if plain == pattern:
        fast = slow
    marks = tuple(special)

    def encode(text: str) -> list[int]:
        own = slow if _DOUBLE_SPACE.search(text) else fast
        if any(m in text for m in marks):
            return own.encode(text, allowed_special="all")
        return own.encode_ordinary(text)

    return encode


def _pieces(vocabulary_, pattern: str, special: dict[str, int], length: int, with_ids: bool):
    def work(batches):
        encode = encoder(vocabulary_.value, pattern, special)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for t in texts_of(b.column("text")):
                rows = []
                for i in range(len(t)):
                    tokens = np.array([*encode(t.bytes(i).decode()), END], "<u4")
                    n = len(tokens)
                    cuts = [0, *range(n % length or length, n, length), n]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = tokens[a:z]
                        rows.append((ids[t.first + i], k, a, z - a, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return work


class Bins:
    """Bins of one size, by their free space."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, set[int]] = {}
        self.mask = 0

    def _enter(self, b: int) -> None:
        f = self.free[b]
        self.by_free.setdefault(f, set()).add(b)
        self.mask |= 1 << f

    def _leave(self, b: int) -> None:
        f = self.free[b]
        own = self.by_free[f]
        own.discard(b)
        if not own:
            self.mask &= ~(1 << f)

    def best(self, need: int, but: int = -1) -> int:
        """A bin with the least space that is enough, or -1."""
        rest = self.mask >> need
        while rest:
            f = need + (rest & -rest).bit_length() - 1
            for b in self.by_free[f]:
                if b != but:
                    return b
            rest &= rest - 1
        return -1

    def add(self, item: int, size: int, b: int) -> None:
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.free.append(self.size)
        else:
            self._leave(b)
        self.items[b].append(item)
        self.free[b] -= size
        self._enter(b)

    def take(self, item: int, size: int, b: int) -> None:
        self._leave(b)
        self.items[b].remove(item)
        self.free[b] += size
        self._enter(b)


def pack(sizes: list[int], size: int) -> list[list[int]]:
    """Items of each bin."""
    bins = Bins(size)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins.add(item, sizes[item], bins.best(sizes[item]))
    _search(bins, sizes, max(-(-sum(sizes) // size), sum(2 * s > size for s in sizes)))
    return [x for x in bins.items if x]


def _search(bins: Bins, sizes: list[int], least: int) -> None:
    """Empty bins until only ``least`` are left, which no packing can beat, or nothing can be moved or exchanged.

    Underfull bins with the same sizes in them are alike, so each kind is
    looked at once, and what found no partner is not tried again before
    something has changed.
    """
    kinds: dict[int, dict[tuple[int, ...], set[int]]] = {}  # free space, sorted sizes, bins
    used = sum(map(bool, bins.items))

    def held(b: int) -> tuple[int, ...]:
        return tuple(sorted(sizes[i] for i in bins.items[b]))

    def enter(b: int) -> None:
        if bins.free[b] and bins.items[b]:
            kinds.setdefault(bins.free[b], {}).setdefault(held(b), set()).add(b)

    def leave(b: int) -> None:
        if bins.free[b] and bins.items[b]:
            own = kinds[bins.free[b]]
            own[held(b)].discard(b)
            if not own[held(b)]:
                del own[held(b)]
            if not own:
                del kinds[bins.free[b]]

    def exchange(given: tuple[int, ...], donor: int, to: int, back: tuple[int, ...]) -> None:
        leave(donor)
        leave(to)
        returned = []
        for wanted in back:
            returned.append(next(i for i in bins.items[to] if sizes[i] == wanted and i not in returned))
        for item in given:
            bins.take(item, sizes[item], donor)
        for item in returned:
            bins.take(item, sizes[item], to)
        for item in given:
            bins.add(item, sizes[item], to)
        for item in returned:
            bins.add(item, sizes[item], donor)
        enter(donor)
        enter(to)

    if used <= least:
        return
    for b in range(len(bins.items)):
        enter(b)
    changed = True
    while changed and used > least:
        changed, stuck = False, set()
        for donor in sorted((b for own in kinds.values() for x in own.values() for b in x), key=lambda b: -bins.free[b]):
            offers = [(i,) for i in sorted(bins.items[donor], key=lambda i: -sizes[i])]
            alike = {sizes[i]: (i, j) for (i,), (j,) in zip(offers, offers[1:], strict=False) if sizes[i] == sizes[j]}
            one = {sizes[i]: i for (i,) in offers}
            offers += [*alike.values(), *((i, j) for i in one.values() for j in one.values() if sizes[i] > sizes[j])]
            for given in offers:
                if not bins.free[donor] or any(i not in bins.items[donor] for i in given):
                    continue
                s = sum(sizes[i] for i in given)
                if (what := (s, len(given), bins.free[donor])) in stuck:
                    continue
                to = bins.best(s, donor)
                back: tuple[int, ...] = ()
                if to < 0 or bins.free[to] > bins.free[donor]:
                    to, back = _partner(kinds, s, donor, bins.free[donor], len(given) == 1)
                if to < 0:
                    stuck.add(what)
                    continue
                exchange(given, donor, to, back)
                stuck.clear()
                changed = True
            if not bins.items[donor]:
                used -= 1
                if used <= least:
                    return


def _partner(kinds: dict[int, dict[tuple[int, ...], set[int]]], s: int, donor: int, free: int, two: bool) -> tuple[int, tuple[int, ...]]:
    """The bin, at least as full as the donor, that ``s`` fills most when it gives back one size or two; else -1."""
    gained, to, back = 0, -1, ()
    for f in sorted((f for f in kinds if f <= free), reverse=True):
        if f <= gained:
            break
        low = s - f
        for have, own in kinds[f].items():
            b = next((b for b in own if b != donor), -1)
            if b < 0:
                continue
            k = bisect.bisect_left(have, low)
            if k < len(have) and s - have[k] > gained:
                gained, to, back = s - have[k], b, (have[k],)
            i, j = 0, len(have) - 1
            while two and i < j:
                both = have[i] + have[j]
                if both < low:
                    i += 1
                else:
                    if s - both > gained:
                        gained, to, back = s - both, b, (have[i], have[j])
                    j -= 1
    return to, back


def _packed(length: int):
    def work(batches):
        from pyspark import TaskContext

        kept = [b for b in batches if len(b)]
        if not kept:
            return
        t = pa.Table.from_batches(kept).combine_chunks()
        sizes = t["length"].to_pylist()
        first = TaskContext.get().partitionId() << 32
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, items in enumerate(pack(sizes, length)):
            sequence[items] = first + k
            offset[items] = np.cumsum([0, *(sizes[i] for i in items)])[:-1]
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=10_000)

    return work


def best_fit_packing(docs: DataFrame, length: int = LENGTH, path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    special = {"<|endoftext|>": 50256} if special is None else special
    out = "doc_id long, piece int, start long, length long, ids_crc32 long"
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    pieces = texts(docs).mapInArrow(_pieces(known, pattern, special, length, with_ids), f"{out}, ids array<long>")
    pieces = written(pieces if with_ids else pieces.drop("ids"))
    shards = max(1, math.ceil(pieces.count() / SHARD))
    # pieces are written, so each has a number; dealt by its hash, a task run again gets the same rows, and equal rows part
    number = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    packed = pieces.withColumn("number", F.xxhash64("doc_id", "piece", "start", "ids_crc32", number)).repartition(shards, "number").drop("number")
    return packed.mapInArrow(_packed(length), f"{out}, ids array<long>, sequence_id long, offset long" if with_ids else f"{out}, sequence_id long, offset long")
