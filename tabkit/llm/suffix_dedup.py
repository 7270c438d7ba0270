"""Suffix-array dedup: remove bytes of strings that occur more than once.

Method: stretches of text whose 200-byte windows may repeat are routed to
shards (see ``repeats``); each shard's distinct contents become one array,
whose suffix array is made by induced sorting and whose permuted common
prefixes tell for each place how much of it occurs elsewhere (see ``sais``).
A window repeats if it shares its whole length with a neighbour in the suffix
array, or if its stretch itself occurs more than once.

Defined results: a null or empty text has no bytes and loses none; strings
are judged on the input, and the same document counts; rows that share a
doc_id doc_id are documents of their own, and so are rows without one; a very long
text is cut into stretches of 326 bytes at most, of which an anchor brings some
together; ties and repeated rows cannot change results; an empty table gives an
empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import texts
from .repeats import Unit, cut_documents, repeated_spans
from .sais import permuted_common_prefixes, suffix_array
from .textbytes import covered, runs

LENGTH = 200
GRAM = 80


def repeated_windows(contents: list[bytes], counts: np.ndarray, least: np.ndarray, anchor: np.ndarray, unit: Unit):
    """Runs of windows (content, first, last, True) that occur more than once in the corpus."""
    w = unit.window
    sizes = np.array([len(c) for c in contents], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    ends = np.zeros(int(sizes.sum()) + len(sizes), bool)
    ends[start + sizes] = True
    text = np.ones(len(ends), np.int64)  # symbol 1 ends a content; no byte has it
    text[~ends] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 2
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    room = start[owner] + sizes[owner] - np.arange(len(text)) >= w
    # a whole window is shared only by places with room for it, as the end is no byte
    shared = permuted_common_prefixes(text, order, w)
    repeated = shared >= w
    left = order[:-1][shared[order[1:]] >= w]
    repeated[left] = True
    repeated |= counts[owner] > 1
    a, z = runs(repeated & room)
    return owner[a], (a - start[owner[a]]).astype(np.int32), (z - start[owner[a]]).astype(np.int32), np.ones(len(a), bool)


def _remove(b: pa.RecordBatch, texts, spans) -> pa.RecordBatch:
    removed, n_spans, kept = [], [], []
    for i, s in enumerate(spans):
        data = texts.data[texts.off[i] : texts.off[i + 1]]
        if len(s):
            gone = covered(len(data), s[:, 0], s[:, 1])
            n_spans.append(len(runs(gone)[0]))
            removed.append(int(gone.sum()))
            data = data[~gone]
        else:
            removed.append(0)
            n_spans.append(0)
        kept.append(data.tobytes())
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id"), pa.array(np.diff(texts.off)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def _digest(work):
    def digest(b, texts, spans):
        r = work(b, texts, spans)
        i = r.schema.get_field_index("kept")
        return r.set_column(i, "kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in r.column("kept").to_pylist()], pa.string()))

    return digest


def suffix_dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept (or their digest)."""
    docs, unit = texts(docs), Unit(False, length, min(GRAM, max(1, 2 * length // 5)))
    spans = repeated_spans(docs, unit, repeated_windows, False)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, "
    return cut_documents(docs, spans, _digest(_remove) if digest else _remove, out + ("kept_sha256 string" if digest else "kept binary"))
