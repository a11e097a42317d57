"""A compressed full-text index over word ids: FM-index on a wavelet matrix.

All steps work on many patterns at a time with numpy; there is no loop over
words or patterns in Python.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in a sequence of ids, from one bit vector for each bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.zeros: list[int] = []
        row, names = symbols.astype(np.int32), np.arange(sigma, dtype=np.int64)
        first = np.zeros(sigma, np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            packed = np.packbits(np.r_[bit.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.sums.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            first = self._down(first, (names >> level) & 1, len(self.words) - 1)
            order = bit == 0
            row = np.concatenate([row[order], row[~order]])
        self.first = first  # where a symbol's run starts on the last level

    def _down(self, at: np.ndarray, bit: np.ndarray, k: int) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.sums[k][block] + np.bitwise_count(self.words[k][block] & mask)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        for k in range(self.bits):
            at = self._down(at, (symbol >> (self.bits - 1 - k)) & 1, k)
        return at - self.first[symbol]


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``ids`` by their first ``depth + 1`` symbols at least, ties by
    position, and whether each suffix in it shares fewer than ``depth`` symbols
    with the one before.

    Prefix doubling: a rank by 2k symbols is that by k symbols of a pair.
    """
    n = len(ids)

    def ranked(pair):
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(sorted_pair[1:] != sorted_pair[:-1])]
        return rank, order

    ranks, order = {}, None
    ranks[1], order = ranked(ids.astype(np.int64))
    k = 1
    while k <= depth:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = ranks[k][k:] + 1
        ranks[2 * k], order = ranked(ranks[k] * (n + 1) + after)
        k *= 2
    one, two, same = order[1:], order[:-1], np.ones(n - 1, bool)
    done = 0
    for bit in sorted(ranks, reverse=True):  # depth as a sum of powers of two
        if depth - done >= bit:
            inside = np.maximum(one, two) + done < n
            same &= inside
            same[inside] &= ranks[bit][one[inside] + done] == ranks[bit][two[inside] + done]
            done += bit
    return order, np.r_[True, ~same]


class FMIndex:
    """Backward search over the words of a shard, with matches held at ``depth``.

    ``text`` is the segments' ids (from 1), each followed by 0.  Matches are never
    longer than ``depth`` before a step, so the order need not look further than
    one symbol more.
    """

    def __init__(self, text: np.ndarray, depth: int):
        sigma = int(text.max()) + 1
        self.sa, edge = suffix_array(text, depth)
        self.depth, self.n = depth, len(text)
        self.bwt = WaveletMatrix(text[self.sa - 1], sigma)  # -1: the last 0 precedes the first segment
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))][:sigma]
        self.start = np.flatnonzero(edge)  # where neighbours share fewer than depth symbols
        self.of = (np.cumsum(edge) - 1).astype(np.int32)
        self.end = np.r_[self.start[1:], self.n]

    def back(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before them."""
        n = len(lo)
        both = self.bwt.rank(np.r_[symbol, symbol], np.r_[lo, hi])
        return self.less[symbol] + both[:n], self.less[symbol] + both[n:]

    def matching(self, streams: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stream segments through the index from right to left.  For each position
        of ``streams``, the interval of the ``depth`` words there (empty: fewer words
        are left, or they don't occur).  A word's id is -1 if the index lacks it.

        A match of ``depth`` words is widened before the next step, by its last word's
        leaving, to all suffixes that share the ``depth`` words before it; a match
        that ends anew costs the steps since its start.
        """
        low, high = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
        order = np.argsort(-lengths, kind="stable")
        at, left = (starts + lengths)[order], lengths[order]
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        size = np.zeros(len(at), np.int64)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            m = int(np.searchsorted(-left, -step, side="left"))  # segments with more words than steps so far
            lo, hi, size = lo[:m], hi[:m], size[:m]
            where = at[:m] - 1 - step
            symbol = streams[where]
            lo, hi = self.back(lo, hi, np.maximum(symbol, 0))
            size = size + 1
            gone = (hi <= lo) | (symbol < 0)
            if gone.any():  # shorter parts of the match may go on
                lo[gone], hi[gone], size[gone] = self._again(streams, where[gone], size[gone])
            full = size >= self.depth
            if full.any():
                run = self.of[lo[full]]
                lo[full], hi[full], size[full] = self.start[run], self.end[run], self.depth
                low[where[full]], high[where[full]] = lo[full], hi[full]
        return low, high

    def _again(self, streams, where, size):
        """The longest match that starts at each place ``where`` and has fewer than
        ``size`` words, found word by word from its end."""
        out = np.zeros((3, len(where)), np.int64)
        out[1] = self.n
        todo = np.arange(len(where))
        size = size - 1
        while len(todo):
            todo = todo[size[todo] > 0]
            if not len(todo):
                break
            lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), self.n, np.int64)
            for k in range(int(size[todo].max()) - 1, -1, -1):
                on = (size[todo] > k) & (hi > lo)
                symbol = streams[where[todo[on]] + k]
                lo[on], hi[on] = self.back(lo[on], hi[on], np.maximum(symbol, 0))
                hi[on] = np.where(symbol < 0, lo[on], hi[on])
            found = hi > lo
            out[:, todo[found]] = lo[found], hi[found], size[todo[found]]
            size[todo] -= 1
            todo = todo[~found]
        return out
