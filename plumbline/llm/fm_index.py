"""An FM-index over a sequence of integer symbols: suffix order by prefix doubling, Burrows-Wheeler transform
in a wavelet tree, sampled suffix positions. Searches run over many patterns at once."""

from __future__ import annotations

import numpy as np

#: Positions that are multiples of this are kept.
SAMPLED = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order; a suffix that ends first is smaller.

    Prefix doubling: ranks by the first k symbols give ranks by 2k. Only suffixes that share a rank are sorted
    again, so that text which does not repeat costs a few rounds over a shrinking rest."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    k = 1
    while True:
        tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True])))) if n else place
        if not len(tied):
            return order
        suffix = order[tied]
        group = rank[suffix]
        after = np.where(suffix + k < n, rank[np.minimum(suffix + k, n - 1)] + 1, 0)
        # one key of two numbers below n + 1 each
        key = group * (n + 1) + after
        again = np.argsort(key, kind="stable")
        order[tied] = suffix[again]
        key = key[again]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[tied] |= new
        rank[order[tied]] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        k *= 2


class Wavelet:
    """Ranks of symbols by the bits of their codes: a level holds one bit of every symbol, stably sorted by the
    bits before (a wavelet matrix), with counts of ones kept for every block of 64."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.n, self.width = len(symbols), width
        self.words, self.sums, self.zeros = [], [], []
        now = symbols
        for level in range(width - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, dtype="<u8")
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.sums.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[k][block] + np.bitwise_count(self.words[k][block] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place `at`."""
        start, at = np.zeros_like(at), at.copy()
        for k in range(self.width):
            one = ((symbol >> (self.width - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, at)
            start, at = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, start, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.width):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._ones(k, start), self._ones(k, at)
            start, at = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - start


class FMIndex:
    """text: symbols from 1 up; 0 is kept for the end."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate((text, [0])).astype(np.int64)
        n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.wavelet = Wavelet(bwt, max(1, int(text.max()).bit_length()))
        marked = order % SAMPLED == 0
        self.marks = np.cumsum(marked)
        self.marked, self.samples, self.n = marked, order[marked], n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range [low, high) of suffixes that begin with each pattern; rows of `patterns` are symbols, all of
        one length. Symbols beyond the text's are found nowhere."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        known = (patterns < len(self.before) - 1).all(axis=1)
        high[~known] = 0
        for column in patterns.T[::-1]:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = column[live]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text position of each suffix, found by walking back to a sampled one."""
        out, now, steps = np.empty(len(place), dtype=np.int64), place.copy(), np.zeros(len(place), dtype=np.int64)
        open_ = np.arange(len(place))
        while len(open_):
            at = now[open_]
            done = self.marked[at]
            end = open_[done]
            out[end] = self.samples[self.marks[at[done]] - 1] + steps[end]
            open_, at = open_[~done], at[~done]
            symbol, rank = self.wavelet.access(at)
            now[open_] = self.before[symbol] + rank
            steps[open_] += 1
        return out
