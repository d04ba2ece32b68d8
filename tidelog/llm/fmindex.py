"""A compressed FM-index over sequences of words: wavelet matrix, backward search, matching statistics.

Vectorised over many patterns at once. Sequences are concatenated, each with
an end mark of its own, so that six rounds of prefix doubling order the
suffixes of sequences of up to 63 words completely. What is kept of a position
are the bits of its symbol with a count at every 64th, a byte for the longest
common prefix with the one before, and a bit that says whether its sequence
occurs more than once; text and suffix array go once the index is built.
"""

from __future__ import annotations

import numpy as np

from tidelog.llm.words import U64

_ROUNDS = (1, 2, 4, 8, 16, 32)
#: Positions to a block of the least common prefixes.
_BLOCK = 64


class WaveletMatrix:
    """Rank of any symbol at any position: a bit vector for each bit of a symbol, packed, with counts at every 64th bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels = []
        for k in range(bits - 1, -1, -1):
            bit = ((symbols >> k) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(U64)
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:], dtype=np.int32)
            zeros = len(bit) - int(counts[-1])
            self.levels.append((k, packed, counts, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of each symbol's own sub-sequence lies in the last level; differences are ranks."""
        for k, packed, counts, zeros in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(packed[block] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))
            at = np.where((symbol >> k) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of one shard. ``weight`` says how often each sequence occurs; at most 63 words a sequence."""

    def __init__(self, hashes: np.ndarray, length: np.ndarray, weight: np.ndarray):
        n = len(length)
        if n and int(length.max()) > 63:
            raise ValueError("a sequence has more than 63 words")
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        ends = np.cumsum(length + 1) - 1
        self.size = int(ends[-1]) + 1 if n else 0
        text = np.zeros(self.size, np.int32)
        inside = np.ones(self.size, bool)
        inside[ends] = False
        text[inside] = codes + 1
        rank = text.astype(np.int64) + n - 1
        rank[ends] = np.arange(n)
        ranks = []
        for k in _ROUNDS:
            ranks.append(rank.astype(np.int32))
            after = np.zeros_like(rank)
            after[:-k] = rank[k:] + 1 if k < len(rank) else 0
            rank = np.unique(rank * (self.size + n + 2) + after, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        #: lcp[i]: words that the suffixes at i - 1 and i share; -1 at both ends.
        self.lcp = np.full((self.size // _BLOCK + 1) * _BLOCK + 1, -1, np.int8)
        if self.size:
            a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(self.size - 1, np.int64)
            for k, r in zip(_ROUNDS[::-1], ranks[::-1], strict=True):
                same = r[np.minimum(a, self.size - 1)] == r[np.minimum(b, self.size - 1)]
                same &= (a < self.size) & (b < self.size)
                common += k * same
                a += k * same
                b += k * same
            self.lcp[1 : self.size] = common
        self.least = self.lcp[:-1].reshape(-1, _BLOCK).min(axis=1)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(len(self.vocabulary)).bit_length()))
        first = np.bincount(text, minlength=len(self.vocabulary) + 1)
        symbols = np.arange(len(self.vocabulary) + 1)
        self.base = np.cumsum(first) - first - self.wavelet.rank(symbols, np.zeros(len(symbols), np.int64)) if self.size else np.zeros(1, np.int64)
        self.several = np.packbits(np.repeat(np.asarray(weight) > 1, length + 1)[order], bitorder="little") if n else np.empty(0, np.uint8)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word that no sequence holds."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of a word put before what [low, high) matches."""
        base = self.base[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)

    def often(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether what an interval stands for occurs more than once."""
        one = np.minimum(low, max(0, self.size - 1))
        return (high - low > 1) | ((high - low == 1) & ((self.several[one >> 3] >> (one & 7)) & 1 == 1))

    def _smaller(self, at: np.ndarray, depth: np.ndarray, back: bool) -> np.ndarray:
        """The nearest position from ``at`` on, back or forth, whose common prefix is shorter than ``depth``."""
        out, block = at.copy(), at // _BLOCK
        todo = np.flatnonzero(self.lcp[at] >= depth)
        within, first = np.arange(_BLOCK), True
        while len(todo):
            rows = self.lcp[block[todo, None] * _BLOCK + within] < depth[todo, None]
            if first:
                rows &= within <= (at[todo] % _BLOCK)[:, None] if back else within >= (at[todo] % _BLOCK)[:, None]
            hit = rows.any(axis=1)
            place = _BLOCK - 1 - rows[:, ::-1].argmax(axis=1) if back else rows.argmax(axis=1)
            out[todo[hit]] = block[todo[hit]] * _BLOCK + place[hit]
            todo, first = todo[~hit], False
            for d in np.unique(depth[todo]).tolist():  # on to the next block whose least is smaller
                some, blocks = todo[depth[todo] == d], np.flatnonzero(self.least < d)
                block[some] = blocks[np.searchsorted(blocks, block[some]) - 1] if back else blocks[np.searchsorted(blocks, block[some], side="right")]
        return out

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger interval of a common prefix, and its length: what is left when the last words are dropped."""
        depth = np.maximum(self.lcp[low], self.lcp[high])
        return self._smaller(low, depth, True), self._smaller(high, depth, False), depth

    def statistics(self, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Streams texts past the index, right to left: for each of their words, how many words from there on occur more than once here."""
        out, codes = np.zeros(len(hashes), np.int64), self.codes(hashes)
        if not self.size:
            return out
        end = np.cumsum(length)
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.size, np.int64)
        depth, at = np.zeros(len(length), np.int64), end - 1
        live = np.flatnonzero(length > 0)
        while len(live):
            symbol = codes[at[live]]
            lo, hi = self.extend(symbol, low[live], high[live])
            ok = (symbol > 0) & self.often(lo, hi)
            grown = live[ok]
            low[grown], high[grown] = lo[ok], hi[ok]
            depth[grown] += 1
            rest = live[~ok]
            stuck = rest[(depth[rest] == 0) | (codes[at[rest]] == 0)]
            low[stuck], high[stuck], depth[stuck] = 0, self.size, 0
            short = rest[(depth[rest] > 0) & (codes[at[rest]] > 0)]
            if len(short):
                low[short], high[short], depth[short] = self.parent(low[short], high[short])
            done = np.concatenate([grown, stuck])
            out[at[done]] = depth[done]
            at[done] -= 1
            live = np.concatenate([done[at[done] >= end[done] - length[done]], short])
        return out
