"""Benchmark decontamination by training suffix arrays.

Each shard (a slice of a partition's documents) sorts the suffixes of its own
words by prefix doubling; every suffix of the test set is then binary-searched
in that order. The interval found holds all verbatim occurrences of the
suffix's window, with their places: they are marked as covered, an interval at
a time, and the places that no longer match further left are extended to their
longest match. Documents hold nothing but their own shard's array, so the work
is one narrow map over the corpus: no shuffle, and memory bounded by a shard
plus one part of the test set. Test suffixes with equal windows are searched
once. A test set of more than ``PASS_WORDS`` words is dealt to several passes,
with what was found so far written to the shared folder in between.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.
Words that the test set does not hold end what can match and open no suffix.
A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.

Defined results: a null text has no words; a document without words has zero
counts and the digest of the empty string; repeated documents each get their
row; repeated items count once by item_id; items with a null id or without
words find nothing; an empty test set leaves every document clean. Long texts
are searched whole. Columns other than id and text pass through ``remove``
untouched and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import pick, settle
from tidelog.llm.words import ALNUM_LOWER, U64, Words, mix, steps

#: Words of the test set, at four characters each, that one pass ships to the workers (some 100 MB).
PASS_WORDS = 2_000_000
SHARD_BYTES = 8 << 20
#: Pairs of places that are compared at once.
PAIRS = 1 << 21
_BASE = 0x9E3779B97F4A7C15


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and each number in it, of all ranges."""
    n = np.maximum(end - start, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]


class Line:
    """Codes of the words of several texts in one line, with a 0 after each text; ``base`` is where each text begins."""

    def __init__(self, codes: np.ndarray, words: Words):
        self.base = words.first[:-1] + np.arange(len(words.count))
        self.codes = np.zeros(len(codes) + len(words.count), np.int64)
        self.place = np.arange(len(codes)) + words.doc
        self.codes[self.place] = codes

    def keys(self, bits: int, per: int, beyond: int) -> np.ndarray:
        """``per`` codes from each place, packed."""
        codes, out = np.r_[self.codes, np.zeros(per + beyond, np.int64)], np.zeros(len(self.codes) + beyond, np.int64)
        for k in range(per):
            out = (out << bits) | codes[k : k + len(out)]
        return out

    def left(self) -> np.ndarray:
        """How many words follow from each place to the next 0."""
        zeros = np.flatnonzero(self.codes == 0)
        return zeros[np.searchsorted(zeros, np.arange(len(self.codes)))] - np.arange(len(self.codes)) if len(zeros) else np.empty(0, np.int64)

    def hashes(self, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Running hashes of the codes, in which no 0 equals anything, and the powers that move them to a common origin."""
        values = mix(np.where(self.codes > 0, self.codes, -(np.arange(len(self.codes)) * 2 + salt)).view(U64)) if len(self.codes) else np.empty(0, U64)
        power = np.full(len(values) + 1, U64(_BASE))
        back = np.full(len(values) + 1, U64(pow(_BASE, -1, 1 << 64)))
        power[0] = back[0] = 1
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * np.cumprod(power, dtype=U64)[:-1], out=total[1:])
        return total, np.cumprod(back, dtype=U64)


class TestSuffixes:
    """Suffixes of some items, as codes of their words (1 and up in the order of the word hashes), and their distinct windows."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM_LOWER)
        self.vocabulary, first, codes = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.bytes = ALNUM_LOWER.fold[words.raw]
        self.start, self.end = words.start[first], words.end[first]
        self.line = Line(codes + 1, words)
        self.item_id = np.array([i for i, _ in items], np.int64)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per = 63 // self.bits
        self.item = np.repeat(np.arange(len(items)), words.count + 1)
        self.longest = int(words.count.max(initial=0))
        keys, left = self.line.keys(self.bits, self.per, window), self.line.left()
        size = np.minimum(np.repeat(words.count, words.count + 1), window)
        at = np.flatnonzero((left >= size) & (self.line.codes > 0))
        rows = [size[at], *(self._chunk(keys, at, size[at], j, 0) for j in range(-(-window // self.per)))]
        order = np.lexsort((at, *rows[::-1])) if len(at) else at
        new = np.zeros(len(order), bool)
        new[:1] = True
        for r in rows:
            new[1:] |= r[order][1:] != r[order][:-1]
        #: Places of the windows; those from cut[w] to cut[w + 1] are equal.
        self.at, self.cut = at[order], np.r_[np.flatnonzero(new), len(order)]
        self.size = size[self.at[self.cut[:-1]]]
        every = self.at[self.cut[:-1]]
        self.low = [self._chunk(keys, every, self.size, j, 0) for j in range(len(rows) - 1)]
        self.high = [self._chunk(keys, every, self.size, j, 1) for j in range(len(rows) - 1)]

    def _chunk(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, j: int, fill: int) -> np.ndarray:
        """The j-th key of windows, with what lies beyond them filled with zeros or ones."""
        beyond = np.clip((j + 1) * self.per - size, 0, self.per) * self.bits
        low = np.left_shift(np.right_shift(keys[np.minimum(at + j * self.per, len(keys) - 1)], beyond), beyond)
        return low | (np.left_shift(1, beyond) - 1) if fill else low


class Shard:
    """The suffix array of one slice of documents: all suffixes that open with a word of the test set, in order of their codes."""

    def __init__(self, column: pa.Array, test: TestSuffixes, window: int):
        self.words, self.test, self.window = Words(column, ALNUM_LOWER), test, window
        h = self.words.hashes()
        place = np.minimum(np.searchsorted(test.vocabulary, h), max(0, len(test.vocabulary) - 1))
        self.index(np.where(test.vocabulary[place] == h, place + 1, 0) if len(test.vocabulary) else np.zeros(len(h), np.int64))

    def index(self, codes: np.ndarray) -> None:
        test, self.line = self.test, Line(codes, self.words)
        self.keys = self.line.keys(test.bits, test.per, self.window + test.per)
        self.left = self.line.left()
        at = np.flatnonzero(self.line.codes)
        at = at[np.argsort(self.keys[at], kind="stable")]
        depth, rank = test.per, np.zeros(len(self.line.codes) + 1, np.int64)
        key = self.keys[at]
        group = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(at)), 0)) if len(at) else at
        rank[at] = group
        some = np.arange(len(at))
        while depth < test.longest and len(some):
            # Groups that are still together and have a member with more known words.
            more = self.left[at[some]] > depth
            size, live = np.bincount(group[some], minlength=len(at)), np.bincount(group[some], weights=more, minlength=len(at))
            some = some[(size[group[some]] > 1) & (live[group[some]] > 0)]
            if not len(some):
                break
            own, of = at[some], group[some]
            after = np.where(self.left[own] > depth, rank[np.minimum(own + depth, len(rank) - 1)], -1)
            order = np.lexsort((after, of))
            own, after = own[order], after[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (after[1:] != after[:-1])]
            at[some] = own
            group[some] = np.maximum.accumulate(np.where(new, some, 0))
            rank[own] = group[some]
            depth *= 2
        self.suffixes = at

    def _bound(self, probe: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all probes at once in the suffix order."""
        n, per = len(self.suffixes), self.test.per
        lo, hi = np.zeros(len(probe[0]), np.int64), np.full(len(probe[0]), n, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = self.suffixes[np.minimum(mid, n - 1)]
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for j, p in enumerate(probe):
                v = self.keys[at + j * per]
                less |= equal & (v < p)
                equal &= v == p
            go = (less | equal) if after else less
            lo = np.where(open_ & go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def search(self) -> np.ndarray:
        """Which places of the line some window covers; keeps the windows found and their intervals."""
        test, covered = self.test, np.zeros(len(self.line.codes), bool)
        self.found = self.lo = self.hi = np.empty(0, np.int64)
        while len(self.suffixes) and len(test.size):
            lo, hi = self._bound(test.low, False), self._bound(test.high, True)
            self.found = np.flatnonzero(hi > lo)
            self.lo, self.hi = lo[self.found], hi[self.found]
            edges = np.zeros(len(covered) + 1, np.int64)
            for size in np.unique(test.size[self.found]).tolist():
                own = test.size[self.found] == size
                marks = np.bincount(self.lo[own], minlength=len(self.suffixes) + 1) - np.bincount(self.hi[own], minlength=len(self.suffixes) + 1)
                at = self.suffixes[np.cumsum(marks)[:-1] > 0]
                edges[at] += 1
                edges[at + size] -= 1
            covered = np.cumsum(edges)[:-1] > 0
            if not len(wrong := self._unequal(covered)):
                break
            codes = self.line.codes[self.line.place]
            codes[wrong] = 0
            self.index(codes)
        return covered

    def _unequal(self, covered: np.ndarray) -> np.ndarray:
        """Hashes led to the codes; the words themselves decide: words under a cover that are not the test set's."""
        i = np.flatnonzero(covered[self.line.place])
        code = self.line.codes[self.line.place[i]] - 1
        size = self.words.end[i] - self.words.start[i]
        wrong = size != self.test.end[code] - self.test.start[code]
        which, at = _ranges(self.words.start[i], np.where(wrong, 0, self.words.end[i]))
        there = at - self.words.start[i][which] + self.test.start[code][which]
        wrong[which[ALNUM_LOWER.fold[self.words.raw[at]] != self.test.bytes[there]]] = True
        return i[wrong]

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.line.base, place, side="right") - 1

    def matches(self) -> tuple[np.ndarray, ...]:
        """After ``search``: document, item, place here, place in the test set and length of the longest match of each document with each item; the leftmost of equals."""
        test, best = self.test, [np.empty(0, np.int64)] * 5
        if not len(self.found):
            return tuple(best)
        of, spot = _ranges(self.lo, self.hi)
        here = self.suffixes[spot]
        before = np.where(here > 0, self.line.codes[here - 1], 0)
        order = np.lexsort((here, before, of))
        here, name = here[order], of[order] * (len(test.vocabulary) + 1) + before[order]
        first = np.searchsorted(of, np.arange(len(self.found) + 1))
        window, place = _ranges(test.cut[self.found], test.cut[self.found + 1])
        there = test.at[place]
        prior = np.where(there > 0, test.line.codes[there - 1], 0)
        own = window * (len(test.vocabulary) + 1) + prior
        # Places after the same word are part of a longer match; the others lie on both sides of them.
        a = np.where(prior > 0, np.searchsorted(name, own), first[window])
        b = np.where(prior > 0, np.searchsorted(name, own, side="right"), first[window])
        start, end, test_at = np.r_[first[window], b], np.r_[a, first[window + 1]], np.r_[there, there]
        keep = end > start
        start, end, test_at = start[keep], end[keep], test_at[keep]
        size = test.size[np.searchsorted(test.cut, np.r_[place, place][keep], side="right") - 1]
        hashes = self.line.hashes(0), test.line.hashes(1)
        while len(start):
            taken = max(1, int(np.searchsorted(np.cumsum(np.minimum(end - start, PAIRS)), PAIRS, side="right")))
            stop = np.minimum(end[:taken], start[:taken] + PAIRS)
            which, spot = _ranges(start[:taken], stop)
            best = self._longest(best, here[spot], test_at[which], size[which], hashes)
            if stop[-1] < end[taken - 1]:
                taken, start[taken - 1] = taken - 1, stop[-1]
            start, end, test_at, size = start[taken:], end[taken:], test_at[taken:], size[taken:]
        return tuple(best)

    def _longest(self, best: list[np.ndarray], here: np.ndarray, there: np.ndarray, size: np.ndarray, hashes: tuple) -> list[np.ndarray]:
        """Adds pairs of places to the best of each document and item."""
        (h, back_h), (t, back_t) = hashes
        left = self.test.line.left()
        lo, hi = size.copy(), np.minimum(self.left[here], left[there])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (h[here + mid] - h[here]) * back_h[here] == (t[there + mid] - t[there]) * back_t[there]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out = [np.concatenate(x) for x in zip(best, (self.doc(here), self.test.item_id[self.test.item[there]], here, there, lo), strict=True)]
        order = np.lexsort((out[3], out[2], -out[4], out[1], out[0]))
        out = [x[order] for x in out]
        first = np.r_[True, (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])]
        out = [x[first] for x in out]
        for i, (a, b, n) in enumerate(zip(*(x.tolist() for x in out[2:]), strict=True)):
            unequal = np.flatnonzero(self.line.codes[a : a + n] != self.test.line.codes[b : b + n])
            if len(unequal):  # equal hashes of unequal words: the pair is as long as its words agree
                out[4][i] = unequal[0]
        return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str, window: int, pass_words: int) -> Iterator[tuple[TestSuffixes, bool]]:
    """Parts of the test set, and whether each is the last."""
    rows, n, ready = [], 0, None
    items = benchmark.selectExpr(f"CAST(`{item_col}` AS BIGINT) AS item_id", f"CAST(`{text_col}` AS STRING) AS text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for item_id, text in items.distinct().toLocalIterator():
        rows.append((item_id, text))
        n += len(text) // 4 + 1
        if n >= pass_words:
            if ready:
                yield ready, False
            ready, rows, n = TestSuffixes(rows, window), [], 0
    if rows or not ready:
        if ready:
            yield ready, False
        ready = TestSuffixes(rows, window)
    yield ready, True


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
MATCH = pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])


def _structs(kind: pa.StructType, doc: np.ndarray, n: int, *fields: np.ndarray) -> pa.Array:
    """A list of structs for each of n documents; rows in the order of their documents."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(kind)))


def _spans(shard: Shard, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of each covered stretch."""
    turn = np.diff(np.r_[0, covered.astype(np.int8), 0])
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    doc = shard.doc(start)
    return doc, start - shard.line.base[doc], end - shard.line.base[doc]


def _pass(test: TestSuffixes, window: int):
    def search(batches):
        for batch in batches:
            for part in steps(batch, "text", SHARD_BYTES):
                shard, n = Shard(part.column("text"), test, window), part.num_rows
                covered = shard.search()
                doc, item, here, there, size = shard.matches()
                found = [doc, item, there - test.line.base[test.item[there]], here - shard.line.base[doc], size]
                if len(old := part.column("matches").flatten()):
                    names = np.repeat(np.arange(n), np.asarray(part.column("matches").value_lengths()))
                    found = [np.r_[x, y] for x, y in zip((names, *(np.asarray(c) for c in old.flatten())), found, strict=True)]
                    order = np.lexsort((found[2], found[3], -found[4], found[1], found[0]))
                    found = [x[order] for x in found]
                    first = np.r_[True, (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])]
                    found = [x[first] for x in found]
                if len(old := part.column("spans").flatten()):
                    names = np.repeat(np.arange(n), np.asarray(part.column("spans").value_lengths()))
                    _, at = _ranges(*(shard.line.base[names] + np.asarray(c) for c in old.flatten()))
                    covered[at] = True
                spans = _structs(SPAN, (s := _spans(shard, covered))[0], n, *s[1:])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(shard.words.count, pa.int64()), spans, _structs(MATCH, found[0], n, *found[1:])], names=["doc_id", "text", "n_words", "spans", "matches"])

    return search


SCHEMA = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, matches array<struct<item_id:long,item_word:long,doc_word:long,n_words:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, the stretches of hit words (spans) and the longest match with each item that has a window in the document (matches)."""
    empty = lambda kind: F.array().cast(kind)
    found = pick(docs, id_col, text_col).select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), empty("array<struct<start:long,end:long>>").alias("spans"), empty("array<struct<item_id:long,item_word:long,doc_word:long,n_words:long>>").alias("matches"))
    for test, last in _passes(benchmark, item_col, item_text_col, window, pass_words):
        found = found.mapInArrow(_pass(test, window), SCHEMA)
        found = found if last else settle(found, "passes")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.transform("matches", lambda m: m["item_id"].cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.coalesce(F.array_max("matches.n_words"), F.lit(0).cast("long")).alias("longest_match"), "spans", "matches",
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, pass_words: int = PASS_WORDS) -> DataFrame:
    """The documents, all columns as they are, in which no window of the test set occurs."""

    def keep(test: TestSuffixes):
        def run(batches):
            for batch in batches:
                for part in steps(batch, text_col, SHARD_BYTES):
                    shard = Shard(part.column(text_col), test, window)
                    hit = np.bincount(shard.doc(np.flatnonzero(shard.search())), minlength=part.num_rows) > 0
                    yield part.filter(pa.array(~hit))

        return run

    for test, last in _passes(benchmark, item_col, item_text_col, window, pass_words):
        docs = docs.mapInArrow(keep(test), docs.schema)
        docs = docs if last else settle(docs, "passes")
    return docs
