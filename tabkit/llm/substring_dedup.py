"""Substring dedup: remove words of passages that an earlier document holds.

Method: stretches of words whose 50-word windows may repeat are routed to
shards (see ``repeats``).  A shard puts the contents of earlier documents into
a compressed FM-index and streams those of later ones against it: backward
search over the wavelet matrix gives matching statistics, and intervals of 50
words or more that match are reported.  Which contents are indexed halves from
pass to pass: of the contents that share an anchor, the half of smaller doc_ids
is indexed and the other half streamed; then both halves are parted again, the
second without what it was found to hold, until a part has one doc_id.  Only
windows whose 10-grams all occur on the other side are indexed or streamed.  Equal
contents are one, with their least doc_id; other documents that hold it lose it.

Defined results: a null or empty text has no words; windows are judged on the
input; only a smaller doc_id counts, so rows that share a doc_id keep what
they share; rows without doc_id have no smaller one and are no one's, so they
take no part; a very long text is cut into stretches of 176 words at most, of
which an anchor brings some together; ties and repeated rows cannot change
results; an empty table gives an empty one; other columns, whatever their
names, are ignored or carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .fmindex import FMIndex
from .frames import plain_names, texts
from .repeats import Unit, cut_documents, repeated_spans
from .textbytes import SPACE_WORD, Prefix, Words, covered, mix, runs

WORDS = 50
GRAM = 10


def _places(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of some spans, one after another."""
    size = end - start
    return np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _pieces(start: np.ndarray, end: np.ndarray, keep: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows to ``keep`` in some spans: of which span, start and end."""
    size = end - start - w + 1
    at, of = _places(start, end - w + 1), np.repeat(np.arange(len(start)), size)
    at, of = at[keep[at]], of[keep[at]]
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]), [True]))
    first, last = np.flatnonzero(new[:-1])[: len(at)], np.flatnonzero(new[1:])[: len(at)]
    return of[first], at[first], at[last] + w


def earlier_windows(contents: list[bytes], counts: np.ndarray, least: np.ndarray, anchor: np.ndarray, unit: Unit):
    """Runs of windows (content, first, last, whether they count in the content's least document too).

    A run counts in the least document if a document with a smaller doc_id
    holds its windows, and in all others that hold the content.
    """
    w = unit.window
    split = [c.split() for c in contents]
    sizes = np.array([len(x) for x in split], np.int64)
    known: dict[bytes, int] = {}
    # symbol 1 parts contents; one follows each
    text = np.ones(int(sizes.sum()) + len(sizes), np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    text[_places(base, base + sizes)] = [known.setdefault(x, len(known) + 2) for words in split for x in words]
    held = np.zeros(len(text), bool)
    grams = np.unique(Prefix(mix(text.astype(np.uint64))).grams(unit.gram), return_inverse=True)[1]

    def possible(start, end, other_start, other_end):
        """What of some spans holds only windows whose grams all occur in the others."""
        occurs = np.zeros(len(grams), bool)
        occurs[grams[_places(other_start, other_end - unit.gram + 1)]] = True
        lacking = np.concatenate(([0], np.cumsum(~occurs[grams])))
        width = w - unit.gram + 1
        return _pieces(start, end, lacking[width:] == lacking[:-width], w)[1:]

    # pieces of contents, from where to where, and the group of each
    own, start, end = np.arange(len(contents)), base, base + sizes
    group = np.unique(anchor, return_inverse=True)[1]
    while True:
        by = np.lexsort((least[own], group))
        own, start, end, group = own[by], start[by], end[by], group[by]
        head = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
        step = np.concatenate(([False], (group[1:] == group[:-1]) & (least[own[1:]] != least[own[:-1]])))[: len(group)]
        number = np.cumsum(step)
        at = np.flatnonzero(head)
        many = np.diff(np.append(at, len(group)))
        number -= np.repeat(number[at], many)
        top = np.repeat(np.maximum.reduceat(number, at) if len(at) else number, many)
        go = top > 0
        if not go.any():
            break
        own, start, end, group, later = own[go], start[go], end[go], group[go], (number > top // 2)[go]
        # a window occurs on the other side only if all its grams do
        a, z = possible(start[later], end[later], start[~later], end[~later])
        found = np.zeros(len(text), bool)
        first, last = possible(start[~later], end[~later], a, z)
        if len(first):
            # a piece may end within a content, where a word follows and no 1
            indexed = text[_places(first, last + 1)]
            indexed[np.cumsum(last + 1 - first) - 1] = 1
            at, inner = _places(a, z), np.cumsum(z - a) - (z - a)
            found[at[FMIndex(indexed, w).matching(text[at], inner, inner + z - a) >= w]] = True
            held |= found
        # what is left of the later ones: runs of windows that were not found
        whose, first, last = _pieces(start[later], end[later], ~found, w)
        whose = np.flatnonzero(later)[whose]
        own = np.concatenate((own[~later], own[whose]))
        start, end = np.concatenate((start[~later], first)), np.concatenate((end[~later], last))
        group = np.unique(np.concatenate((2 * group[~later], 2 * group[whose] + 1)), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    window = np.arange(len(text)) - base[owner] <= sizes[owner] - w
    out = []
    for flags, in_least in ((held & window, True), (~held & window & (counts[owner] > 1), False)):
        a, z = runs(flags)
        out.append((owner[a], (a - base[owner[a]]).astype(np.int32), (z - base[owner[a]]).astype(np.int32), np.full(len(a), in_least)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _remove(b: pa.RecordBatch, texts_, spans) -> pa.RecordBatch:
    words = Words(texts_, SPACE_WORD, False)
    n, removed, kept = np.diff(words.off), [], []
    for i, s in enumerate(spans):
        if len(s):
            gone = covered(n[i], s[:, 0], s[:, 1])
            removed.append(int(gone.sum()))
            own = texts_.bytes(i).split()
            kept.append(b" ".join([own[j] for j in np.flatnonzero(~gone)]))
        else:
            removed.append(0)
            kept.append(b" ".join(texts_.bytes(i).split()))
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _digest(b, texts_, spans):
    r = _remove(b, texts_, spans)
    return r.set_column(3, "kept_sha256", pa.array([hashlib.sha256(x.encode()).hexdigest() for x in r.column("kept").to_pylist()], pa.string()))


def _spans(docs: DataFrame, words: int) -> DataFrame:
    return repeated_spans(texts(docs), Unit(True, words, min(GRAM, max(1, words // 2))), earlier_windows, True)


def substring_dedup(docs: DataFrame, words: int = WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the words kept, joined by spaces (or their digest)."""
    return cut_documents(texts(docs), _spans(docs, words), _digest if digest else _remove, "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string"))


def cut_earlier_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with such passages cut out; texts that lose nothing stay as they are, and texts that lose all go.

    The words kept of a text that loses some are joined by single spaces, so
    line breaks go with the passage.  A column n_chars follows the text, in
    whole numbers of its type.  All columns stay, whatever their names.
    """
    given, docs = docs.columns, plain_names(docs, "n_chars")
    names = docs.columns

    def cut(b, texts_, of):
        new = _remove(b, texts_, of)
        gone, kept = new.column("n_removed").to_pylist(), new.column("kept").to_pylist()
        text = [old if not n else k for old, n, k in zip(b.column("text").to_pylist(), gone, kept, strict=True)]
        if "n_chars" in names:
            i = names.index("n_chars")
            chars = [len(x) if n else old for x, n, old in zip(text, gone, b.column(i).to_pylist(), strict=True)]
            if pa.types.is_integer(kind := b.schema.field(i).type):
                b = b.set_column(i, b.schema.field(i), pa.array(chars, kind))
        i = names.index("text")
        return b.set_column(i, b.schema.field(i), pa.array(text, b.schema.field(i).type)).filter(pa.array([not n or bool(k) for n, k in zip(gone, kept, strict=True)], pa.bool_()))

    return cut_documents(docs, _spans(docs, words), cut, docs.schema).toDF(*given)
