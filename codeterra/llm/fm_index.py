"""A compressed full-text index over words: BWT in a wavelet matrix with bit-packed ranks, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A bit vector with constant-time rank, 64 bits to a word and a running count for each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (values >> level) & 1
            self.levels.append((level, Bits(bit), int(len(values) - bit.sum())))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position; at may hold several rows of positions."""
        low = np.zeros_like(symbol)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; text holds small non-negative integers."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Passages of words (64-bit hashes), each with the rank of its document; says how far left a pattern occurs in a document of lower rank."""

    def __init__(self, passages: list[np.ndarray], docs: np.ndarray):
        self.words = np.unique(np.concatenate(passages))
        text = np.concatenate([np.append(self.encode(p), 0) for p in passages])
        order = suffix_array(text)
        bwt = text[order - 1]
        self.symbols = len(self.words) + 1
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols)))).astype(np.int64)
        self.matrix = WaveletMatrix(bwt, self.symbols)
        self.size = len(text)
        table = np.repeat(docs, [len(p) + 1 for p in passages])[order].astype(np.int32)
        self.lowest = [table]  # of 2 ** k documents from each place on
        while 2 ** len(self.lowest) <= self.size:
            half, last = 2 ** (len(self.lowest) - 1), self.lowest[-1]
            self.lowest.append(np.minimum(last[: len(last) - half], last[half:]))

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Symbols from 1 on; 0 ends a passage. All words must be known."""
        return np.searchsorted(self.words, words).astype(np.int64) + 1

    def earlier(self, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether the interval holds a suffix of a document of lower rank."""
        some = high > low
        k = np.zeros(len(low), dtype=np.int64)
        k[some] = np.frexp((high - low)[some])[1] - 1
        out = np.zeros(len(low), dtype=bool)
        for level in np.unique(k[some]).tolist():
            at = np.flatnonzero(some & (k == level))
            table = self.lowest[level]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << level)]) < doc[at]
        return out

    def reach(self, texts: np.ndarray, end: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each pattern that ends with texts[end], the least start >= stop so that texts[start:end + 1] occurs in a document of lower rank (end + 1: none)."""
        start = end + 1
        live = np.arange(len(end))
        low, high = np.zeros(len(end), dtype=np.int64), np.full(len(end), self.size, dtype=np.int64)
        while len(live):
            symbol = texts[start[live] - 1]
            ranks = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.counts[symbol] + ranks[: len(live)], self.counts[symbol] + ranks[len(live) :]
            ok = self.earlier(low[live], high[live], doc[live])
            live = live[ok]
            start[live] -= 1
            live = live[start[live] > stop[live]]
        return start


def matched_windows(index: FMIndex, passages: list[np.ndarray], docs: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each passage the runs [start, end) that windows found in documents of lower rank cover: matching statistics cut at the window's length.

    Windows are decided from left to right. A window whose backward search fails at a word fails for every window with
    the words from there on, so as many are skipped; after a match the search takes longer patterns, halving on failure.
    """
    sizes = np.array([len(p) for p in passages], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.concatenate([index.encode(p) for p in passages])
    out: list[list[tuple[int, int]]] = [[] for _ in passages]
    done = np.full(len(passages), window - 2, dtype=np.int64)  # windows that end here or before are decided
    step = np.ones(len(passages), dtype=np.int64)
    live = np.flatnonzero(sizes >= window)
    while len(live):
        end = np.minimum(done[live] + step[live], sizes[live] - 1)
        stop = done[live] + 2 - window
        start = index.reach(text, begin[live] + end, begin[live] + stop, docs[live]) - begin[live]
        hit = start <= stop
        for p, a, b in zip(live[hit].tolist(), stop[hit].tolist(), end[hit].tolist()):
            if out[p] and out[p][-1][1] >= a:
                out[p][-1] = (out[p][-1][0], b + 1)
            else:
                out[p].append((a, b + 1))
        single = end == done[live] + 1
        done[live] = np.where(hit, end, np.where(single, start - 2 + window, done[live]))
        step[live] = np.where(hit, np.minimum(2 * step[live], window), np.where(single, 1, np.maximum(step[live] // 2, 1)))
        live = live[done[live] < sizes[live] - 1]
    return out
