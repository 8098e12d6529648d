"""An FM-index over the words of one shard of texts: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; every pair of symbols that ends a text differs.

    Prefixes of several packed symbols are sorted first; ties are then split by doubling, which
    touches only the suffixes that are still tied.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = max(1, min(62 // bits, n))
    packed = np.zeros(n, dtype=np.int64)
    for i in range(width):
        packed <<= bits
        packed[: n - i] |= symbols[i:]
    order = np.argsort(packed)
    keys = packed[order]
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    while True:
        first = np.empty(len(keys), dtype=bool)
        first[0] = True
        np.not_equal(keys[1:], keys[:-1], out=first[1:])
        heads = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        members = order[slots]
        rank[members] = heads
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots, members, heads = slots[tied], members[tied], heads[tied]
        if not len(slots):
            return order
        keys = heads * n + rank[members + width]
        by_key = np.argsort(keys)
        order[slots] = members[by_key]
        keys = keys[by_key]
        width *= 2


class FMIndex:
    """Counts and locates word phrases in a shard of texts.

    hashes: the words of all texts in a row; bounds: where each text begins, and the end.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        n_texts = len(bounds) - 1
        by_hash = np.argsort(hashes)
        ordered = hashes[by_hash]
        fresh = np.ones(len(ordered), dtype=bool)
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        self.vocabulary = ordered[fresh]
        ids = np.empty(len(hashes), dtype=np.int64)
        ids[by_hash] = np.cumsum(fresh)
        # each text ends with a mark of its own; marks come before words, in the order of texts
        text_of = np.repeat(np.arange(n_texts), np.diff(bounds))
        self.n = len(hashes) + n_texts
        symbols = np.empty(self.n, dtype=np.int64)
        places = np.arange(len(hashes)) + text_of
        ends = bounds[1:] + np.arange(n_texts)
        symbols[places] = ids + (n_texts - 1)
        symbols[ends] = np.arange(n_texts)
        order = suffix_order(symbols)
        symbols = np.maximum(symbols - (n_texts - 1), 0)  # every mark is 0 from here on
        symbols[ends] = 0
        self.last = symbols[order - 1].astype(np.int32)
        self.before = np.zeros(len(self.vocabulary) + 2, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 1), out=self.before[1:])
        starts = np.zeros(self.n, dtype=bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        sampled = starts[order] | (order % SAMPLE == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.starts = bounds[:-1] + np.arange(n_texts)
        self._wavelet()

    def _wavelet(self) -> None:
        sequence = self.last
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in reversed(range(max(1, len(self.vocabulary).bit_length()))):
            zero = ((sequence >> level) & 1) == 0
            counts = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(zero, out=counts[1:])
            self.levels.append((level, counts, int(counts[-1])))
            sequence = np.concatenate([sequence[zero], sequence[~zero]])

    def _trace(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, n_zeros in self.levels:
            z = zeros[at]
            at = np.where((symbols >> level) & 1 == 0, z, n_zeros + at - z)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before row ``at`` of the last column."""
        both = self._trace(np.concatenate([symbols, symbols]), np.concatenate([at, np.zeros_like(at)]))
        return both[: len(at)] - both[len(at) :]

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 where the shard lacks the word."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases; each row of ``phrases`` is symbols, right-aligned, 0 in none."""
        width = phrases.shape[1]
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(width):
            active = np.flatnonzero((lengths > back) & (high > low))
            if not len(active):
                break
            symbol = phrases[active, width - 1 - back]
            base = self.before[symbol]
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[active], high[active]]))
            low[active] = base + both[: len(active)]
            high[active] = base + both[len(active) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word positions (over all texts in a row) where the suffixes of these rows begin."""
        found = np.empty(len(rows), dtype=np.int64)
        index, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(rows):
            done = self.sampled[rows]
            found[index[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            index, rows = index[~done], rows[~done]
            if len(rows):
                symbol = self.last[rows].astype(np.int64)
                rows = self.before[symbol] + self.rank(symbol, rows)
                steps += 1
        return found - (np.searchsorted(self.starts, found, side="right") - 1)
