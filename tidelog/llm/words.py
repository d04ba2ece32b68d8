"""Vectorised words over Arrow text columns.

A batch of texts is treated as one byte buffer. Word boundaries and 64-bit
word hashes come from a few NumPy passes over the bytes, so no Python object
is made per word. All non-ASCII bytes belong to words under both rules here,
hence working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 2 << 20

_ODD = 0x9E3779B97F4A7C17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Tables:
    """Made on first use in each process, never shipped."""

    values: np.ndarray | None = None
    power: np.ndarray
    inverse: np.ndarray

    @classmethod
    def get(cls) -> type[_Tables]:
        if cls.values is None:
            cls.power = _powers(_ODD, PIECE + 1)
            cls.inverse = _powers(pow(_ODD, -1, 1 << 64), PIECE + 1)
            cls.values = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        return cls


class Rule:
    """Which bytes make words, and how bytes are folded before they are compared."""

    def __init__(self, is_word: np.ndarray, lower: bool):
        self.is_word = is_word
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32


def _rule(separators: list[int], lower: bool) -> Rule:
    ok = np.ones(256, dtype=bool)
    ok[separators] = False
    return Rule(ok, lower)


_BLANKS = [0x20, *range(0x09, 0x0E)]
#: Words between blanks, unchanged.
BLANK = _rule(_BLANKS, False)
#: Words between blanks, A-Z in lower case.
BLANK_LOWER = _rule(_BLANKS, True)
#: Runs of digits, letters and non-ASCII characters, A-Z in lower case.
ALNUM_LOWER = _rule([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with about ``size`` bytes of text; a longer text is a slice of its own."""
    _, offsets = flat(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of a slice of texts: ``start`` and ``end`` bytes, ``doc`` of each, ``first[i]`` the first word of text i."""

    def __init__(self, column: pa.Array, rule: Rule):
        self.rule = rule
        self.raw, self.offsets = flat(column)
        raw, offsets, n = self.raw, self.offsets, len(self.raw)
        inside = rule.is_word[raw]
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = False
        edge[1:] = inside
        head = offsets[:-1]
        edge[head[head < n]] = False
        self.start = np.flatnonzero(inside & ~edge[:n])
        edge[:n] = inside
        edge[n] = False
        edge[offsets[1:]] = False
        self.end = np.flatnonzero(inside & ~edge[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        t = _Tables.get()
        start, end = self.start, self.end
        out = np.empty(len(start), dtype=U64)
        i = 0
        while i < len(start):
            base = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, base + PIECE, side="right")))
            if end[j - 1] - base > PIECE:
                out[i] = self._long(base, int(end[i]))
            else:
                part = t.values[self.rule.fold[self.raw[base : end[j - 1]]]]
                part *= t.power[: len(part)]
                total = np.zeros(len(part) + 1, dtype=U64)
                np.cumsum(part, out=total[1:])
                s = start[i:j] - base
                out[i:j] = (total[end[i:j] - base] - total[s]) * t.inverse[s]
            i = j
        return mix(out)

    def _long(self, start: int, end: int) -> int:
        t, value = _Tables.get(), 0
        for at in range(start, end, PIECE):
            part = t.values[self.rule.fold[self.raw[at : min(end, at + PIECE)]]]
            part *= t.power[: len(part)]
            value += int(part.sum(dtype=U64)) * pow(_ODD, at - start, 1 << 64)
        return value & ((1 << 64) - 1)

    def text(self, i: int) -> bytes:
        """Word i, folded."""
        return self.rule.fold[self.raw[self.start[i] : self.end[i]]].tobytes()


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions have none."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=U64)
    for k in range(n):
        out *= U64(0xD1342543DE82EF95)
        out += h[k : k + m]
    return mix(out)
