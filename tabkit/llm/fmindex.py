"""A compressed FM-index over integer symbols, and matching statistics by backward search.

The index keeps a wavelet matrix of packed bits over the BWT and, for each
row, the symbols shared with the row before, in a byte; the suffix array and
the text are dropped once it is built.  Many patterns are searched in step,
array-wise.
"""

from __future__ import annotations

import numpy as np

from .sais import permuted_common_prefixes, suffix_array


class Bits:
    """Packed bits with the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(n // 64 + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        ones = np.bitwise_count(packed).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = n - int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """The ones before place i."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).view(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    """Rows are suffixes of a text of symbols from 1, in order; row 0 is the end.  ``most``: prefixes count so far."""

    def __init__(self, text: np.ndarray, most: int):
        self.symbols, codes = np.unique(text, return_inverse=True)
        codes = codes + 1
        order = np.concatenate(([len(text)], suffix_array(codes)))
        self.rows = len(order)
        shared = np.concatenate((permuted_common_prefixes(codes, order[1:], most), [0]))[order]
        shared[0] = -1
        kind = np.int8 if most < 128 else np.int32
        least = np.append(shared, -1).astype(kind)  # of the rows before and at each place; -1 beyond both ends
        self.least = [least]
        while 2 << (len(self.least) - 1) <= len(least):
            k, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-k], last[k:]))
        bwt = np.where(order > 0, codes[order - 1], 0)
        sigma = len(self.symbols) + 1
        counts = np.bincount(bwt, minlength=sigma)
        at = np.zeros(sigma, np.int64)
        symbol = np.arange(sigma)
        self.bits = []
        for level in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            one = bwt >> level & 1 == 1
            bits = Bits(one)
            at = self._down(bits, at, symbol >> level & 1 == 1)
            self.bits.append(bits)
            bwt = np.concatenate((bwt[~one], bwt[one]))
        #: What turns a place after the last level into a row.
        self.base = np.cumsum(counts) - counts - at

    @staticmethod
    def _down(bits: Bits, i: np.ndarray, one: np.ndarray) -> np.ndarray:
        ones = bits.ones(i)
        return np.where(one, bits.zeros + ones, i - ones)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """The index's numbers of symbols; 0 for those that it has not."""
        at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
        return np.where(self.symbols[at] == symbols, at + 1, 0)

    def back(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that start with a symbol and go on as rows low to high do."""
        i, both = np.concatenate((low, high)), np.concatenate((code, code))
        for level, bits in zip(range(len(self.bits) - 1, -1, -1), self.bits, strict=True):
            i = self._down(bits, i, both >> level & 1 == 1)
        i = i + self.base[both]
        return i[: len(low)], i[len(low) :]

    def shortened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger ranges, of rows that share a shorter prefix, and its length."""
        length = np.maximum(self.least[0][low], self.least[0][high])
        length = np.maximum(length, 0)
        low, high = low.copy(), high.copy()
        for k in range(len(self.least) - 1, -1, -1):
            table, step = self.least[k], 1 << k
            at = low - step + 1
            ok = at >= 0
            ok[ok] = table[at[ok]] >= length[ok]
            low[ok] -= step
            ok = high < len(table)
            ok[ok] = table[high[ok]] >= length[ok]
            high[ok] += step
        return low, high, length.astype(np.int64)

    def matching(self, pattern: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place of some patterns (parts of one array), the symbols from there that occur in the text, as far as they count."""
        code = self.codes(pattern)
        out = np.zeros(len(pattern), np.int64)
        live = np.flatnonzero(end > start)
        low, high, length = np.zeros(len(live), np.int64), np.full(len(live), self.rows, np.int64), np.zeros(len(live), np.int64)
        at = end[live] - 1
        while len(live):
            todo = np.arange(len(live))
            absent = code[at] == 0
            low[absent], high[absent], length[absent] = 0, self.rows, 0
            todo = todo[~absent]
            while len(todo):
                a, z = self.back(low[todo], high[todo], code[at[todo]])
                ok = z > a
                hit = todo[ok]
                low[hit], high[hit] = a[ok], z[ok]
                length[hit] += 1
                todo = todo[~ok]
                if len(todo):
                    low[todo], high[todo], length[todo] = self.shortened(low[todo], high[todo])
            out[at] = length
            at = at - 1
            more = at >= start[live]
            live, low, high, length, at = live[more], low[more], high[more], length[more], at[more]
        return out
