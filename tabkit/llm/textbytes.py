"""Vectorised access to the UTF-8 bytes of an Arrow text column.

Every operator here reads whole texts.  An Arrow batch is walked in slices of
about ``SLICE`` bytes (one text is never cut), so the working set of a task is
a small multiple of ``SLICE`` or of its longest text, whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 19
#: Bytes of a word, beyond which its hash is taken of it as a whole.
LONG_WORD = 256

#: Bytes 0x20 and 0x09-0x0D part words of the ``[^\\x20\\x09-\\x0D]+`` kind.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and all bytes of non-ASCII characters make words of the
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` kind (after lower-casing A-Z).
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 64, 256, dtype=np.uint64)
_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    if len(_pow.get("p", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Polynomial prefix sums: hashes of all spans of k values.

    They only say where windows are brought together.  Structured spans can
    clash modulo 2**64, so nothing is taken for equal by them.
    """

    def __init__(self, values: np.ndarray):
        self.p, self.q = powers(len(values) + 1)
        self.c = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.p[: len(values)], out=self.c[1:])

    def grams(self, k: int) -> np.ndarray:
        """The hashes of all spans of k values."""
        n = len(self.c) - k
        return mix((self.c[k:] - self.c[:n]) * self.q[:n]) if n > 0 else np.zeros(0, np.uint64)


def digests(parts: Iterator[bytes]) -> np.ndarray:
    """128-bit digests of byte strings, as two columns of 64 bits."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8").reshape(-1, 2)


def shingles(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans of a few words, mixed in word by word."""
    h = mix(length.astype(np.uint64))
    for i in range(int(length.max()) if len(length) else 0):
        more = mix(h * np.uint64(_P) + hashes[np.minimum(start + i, len(hashes) - 1)])
        h = more if i < int(length.min()) else np.where(i < length, more, h)
    return h


class Texts:
    """Consecutive texts of a batch: bytes ``data`` and ``off``, one offset more than texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first = data, off, first

    def __len__(self) -> int:
        return len(self.off) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def texts_of(column: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """Slices of a string column; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Texts(raw[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


class Words:
    """The words of some texts: byte ``start`` and ``end``, and ``off``, the words before each text."""

    def __init__(self, texts: Texts, kind: np.ndarray, lower: bool):
        data = texts.data
        is_word = kind[data]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        last = is_word.copy()
        last[:-1] &= ~is_word[1:]
        edge = texts.off[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] |= is_word[edge]
        last[edge - 1] |= is_word[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, texts.off)
        self.data = LOWER[data] if lower else data
        self.is_word = is_word

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hashes: eight bytes after another are mixed in; of words of one length up to eight bytes, no two have one hash."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + np.uint64(_P))
        data = np.concatenate((self.data, np.zeros(8, np.uint8)))
        of, at, left = np.arange(len(size)), self.start, size
        for _ in range(LONG_WORD // 8):
            if not len(of):
                break
            chunk = np.zeros(len(of), np.uint64)
            for i in range(min(8, int(left.max()))):
                chunk |= np.where(left > i, data[at + i], 0).astype(np.uint64) << np.uint64(8 * i)
            h[of] = mix(h[of] * np.uint64(_P) + mix(chunk * np.uint64(0xD6E8FEB86659FD93)))
            more = left > 8
            of, at, left = of[more], at[more] + 8, left[more] - 8
        for w in np.flatnonzero(size > LONG_WORD):
            h[w] = xxhash.xxh3_64_intdigest(self.data[self.start[w] : self.end[w]].tobytes())
        return h

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one blank after each, and where each starts and ends there."""
        size = self.end - self.start
        start = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.data[self.is_word]
        return out, start, start + size

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit value for each byte, to be summed by ``Prefix``."""
    return _TABLE[data]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n]) > 0
