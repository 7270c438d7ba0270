"""A Bloom filter over a column of longs, gathered by ``bit_or``.

It only spares rows a shuffle: an exact join always follows, and a filter that
has filled up merely lets all rows through.  Its size follows the number of
keys up to ``MOST`` bits (16 MiB), so it can be broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix

LEAST, MOST = 16, 27
#: Bits a key.
ROOM = 16


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.view(np.uint64) + np.uint64(0x1234567))
    mask = np.uint64((1 << bits) - 1)
    return np.stack((h & mask, (h >> np.uint64(32)) & mask))


def has(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; all that are in it are."""
    at = _places(np.ascontiguousarray(keys, np.int64), len(words).bit_length() + 5)
    bits = words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
    return bits.astype(bool).all(axis=0)


def _words(bits: int):
    def work(batches):
        for b in batches:
            keys = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.unique(_places(keys, bits))
            starts = np.flatnonzero(np.concatenate(([True], np.diff(at >> np.uint64(6)) != 0))) if len(at) else at.astype(int)
            word = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array((at[starts] >> np.uint64(6)).astype(np.int64)), pa.array(word.view(np.int64))], ["at", "word"])

    return work


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """At most 2**(MOST - 6) rows reach the driver, whatever the input; ``df`` is read twice."""
    bits = min(MOST, max(LEAST, (ROOM * df.select(column).count()).bit_length()))
    got = df.select(column).mapInArrow(_words(bits), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return words
