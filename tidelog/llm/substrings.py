"""Substring dedup: removes every passage of ``window`` words that occurs anywhere else.

1. Equal texts are collapsed to one with a weight, named by a digest of the
   text, so that copies cost one row of a digest and rows need no number.
2. Each window of words has an anchor: its least 8-word shingle by hash. The
   windows with the same anchor place form a segment, so segments deal out the
   windows of a text, and equal windows have equal anchors. Anchors are
   counted over all texts; a bitmap of fixed size, shipped to the scan, keeps
   segments of anchors that occur once out of what follows (a full bitmap
   would only let more through). Of anchors with many segments the windows are
   counted too, by hash, and segments are cut down to the windows that a second
   such bitmap lets through: around a common passage all others differ.
3. Equal segments are collapsed to one with a weight (partial sums first), so
   a passage that a third of the corpus shares is one row.
4. Segments are dealt by anchor to shards; each shard builds a compressed
   FM-index of its segments and streams the texts' segments past it: backward
   search over the wavelet matrix gives the matching statistics, the longest
   stretch from each word on that occurs more than once; a match that a word
   ends is shortened to its parent interval. Windows within such a stretch
   repeat. An anchor that still has very many segments is dealt by windows.
5. Windows found return to their texts, whose covered words go. Texts without
   any never leave their scan; of a text with very many copies each part of
   the copies gets its own row of windows.

Words are compared by 64-bit hashes, segments by 128 bits and their words,
texts by MD5.

Defined results: a null text has no words; texts shorter than a window lose
nothing; repeated rows repeat each other and so lose every full window; long
texts are read whole; an empty table gives an empty result. Other columns
never clash, as only id and text are read. The rows may come in any order and
be computed anew at any time, as nothing depends on their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.fmindex import FMIndex
from tidelog.llm.shared import drop, join_dealt, parts_of, settle, within
from tidelog.llm.words import BLANK, U64, Words, mix, ngrams, steps

SHINGLE = 8
#: Bits of the bitmaps of anchors and of windows (16 MB each), of anchors with many segments (1 MB) and of texts (4 MB).
ANCHOR_BITS, WINDOW_BITS, COMMON_BITS, TEXT_BITS = 1 << 27, 1 << 27, 1 << 23, 1 << 25
#: Segments of an anchor beyond which windows are counted; distinct segments beyond which it is dealt by windows; words in one index.
COMMON, HEAVY, SHARD_WORDS = 256, 1024, 400_000


def _anchors(h: np.ndarray, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: anchor hash, first window, number of windows, text."""
    none = np.empty(0, np.int64)
    if len(h) < window:
        return none.astype(U64), none, none, none
    g = ngrams(h, SHINGLE)
    span = window - SHINGLE + 1
    best = np.arange(len(g))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        width += step
    starts = np.flatnonzero(np.repeat(words.first[1:], words.count)[: len(best)] - np.arange(len(best)) >= window)
    best = best[starts]
    doc = words.doc[starts]
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]) if len(best) else none
    return g[best[new]], starts[new], np.diff(np.r_[new, len(best)]), doc[new]


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & U64(bits - 1)).astype(np.int64)


def _scan(texts: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over slices of (digest, text, weight): gets the slice, its words and their hashes and yields columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                words = Words(part.column("text"), BLANK)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64)) for x in run(part, words, words.hashes())], names=names)

    return texts.mapInArrow(scan, schema)


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of their values."""
    keys, which = np.unique(keys, return_inverse=True)
    return [keys, *(np.bincount(which, weights=v, minlength=len(keys)).astype(np.int64) for v in values)]


def _counted(texts: DataFrame, window: int) -> DataFrame:
    """anchor, how often it occurs in all rows (n) and in different texts (segments)."""

    def count(part, words, h):
        g, _, _, doc = _anchors(h, words, window)
        return _summed(g, np.asarray(part.column("weight"))[doc], np.ones(len(g)))

    return _scan(texts, count, "anchor long, n long, segments long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("segments").alias("segments"))


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the column ``key``; its size is fixed, whatever their number."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts.toLocalIterator():
        at = (r.part - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r.bits).ljust(4096, b"\0"), np.uint8)
    return out


def _in(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = (h & U64(bits - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7)) & 1 == 1


def _each_window(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segment, and the first word, of each window of segments."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]


def _window_counts(texts: DataFrame, window: int, common: np.ndarray) -> DataFrame:
    """key of each window of common anchors, and how often it occurs."""

    def count(part, words, h):
        g, start, n, doc = _anchors(h, words, window)
        keep = _in(common, COMMON_BITS, g)
        which, at = _each_window(start[keep], n[keep])
        return _summed(_stretch(h, at, at + window, 13), np.asarray(part.column("weight"))[doc[keep]][which])

    return _scan(texts, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _segments(texts: DataFrame, window: int, anchors: np.ndarray, bits: int, common: np.ndarray | None, windows: np.ndarray | None) -> DataFrame:
    """Segments that may repeat: anchor, two keys of the words, text's digest, the first window of each place in the text, weight (over its places), words."""

    def cut(part, words, h):
        g, start, n, doc = _anchors(h, words, window)
        keep = _in(anchors, bits, g)
        g, start, n, doc = g[keep], start[keep], n[keep], doc[keep]
        if common is not None:
            hot = _in(common, COMMON_BITS, g)
            which, at = _each_window(start[hot], n[hot])
            ok = _in(windows, WINDOW_BITS, _stretch(h, at, at + window, 13))
            which, at = which[ok], at[ok]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])]) if len(at) else np.empty(0, np.int64)
            rest = [x[hot][which[new]] for x in (g, doc)]
            g, start, n, doc = (np.r_[x[~hot], y] for x, y in zip((g, start, n, doc), (rest[0], at[new], np.diff(np.r_[new, len(at)]), rest[1]), strict=True))
        end = start + n + window - 1
        keys = [_stretch(h, start, end, salt) for salt in (3, 7)]
        order = np.lexsort((start, keys[1], keys[0], doc))
        new = np.r_[True, np.diff(doc[order]) != 0] if len(order) else np.empty(0, bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        cuts, places = np.r_[np.flatnonzero(new), len(order)], start[order] - words.first[doc[order]]
        at = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places))
        g, start, end, doc, *keys = (x[order[cuts[:-1]]] for x in (g, start, end, doc, *keys))
        raw = words.raw.tobytes()
        texts_ = [raw[a:b] for a, b in zip(words.start[start].tolist(), words.end[end - 1].tolist(), strict=True)]
        weight = np.asarray(part.column("weight"))[doc] * np.diff(cuts)
        return [g, *keys, part.column("digest").take(pa.array(doc, pa.int64())), at, weight, pa.array(texts_, pa.binary())]

    return _scan(texts, cut, "anchor long, key1 long, key2 long, digest binary, at array<long>, weight long, words binary")


def _stretch(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the words from each start to its end."""
    base = 0x9E3779B97F4A7C15 * salt | 1
    power = np.full(len(h) + 1, U64(base & ((1 << 64) - 1)))
    power[0] = 1
    power = np.cumprod(power, dtype=U64)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(salt)) * power[:-1], out=total[1:])
    back = np.full(len(h) + 1, U64(pow(base, -1, 1 << 64)))
    back[0] = 1
    back = np.cumprod(back, dtype=U64)
    return mix((total[end] - total[start]) * back[start] ^ (end - start).astype(U64))


def _binary_words(column: pa.Array) -> Words:
    return Words(column.cast(pa.large_binary()).view(pa.large_string()), BLANK)


def _searched(rows: DataFrame, window: int) -> DataFrame:
    """rows: anchor, salt, key1, key2, words, weight; gives key1, key2 and the mask of windows that repeat within (anchor, salt)."""

    def search(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(group).combine_chunks()
        words = _binary_words(table.column("words").combine_chunks())
        h = words.hashes()
        index = FMIndex(h, words.count, np.asarray(table.column("weight")))
        at = np.flatnonzero(index.statistics(h, words.count) >= window)
        which = np.searchsorted(words.first, at, side="right") - 1
        place = at - words.first[which]
        masks = np.zeros(len(words.count), np.int64)
        np.bitwise_or.at(masks, which, np.int64(1) << place)
        hit = masks != 0
        out = pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().filter(pa.array(hit)) for c in ("key1", "key2")), pa.array(masks[hit])], names=["key1", "key2", "mask"])
        return out if out.num_rows else None

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            names = list(zip(batch.column("anchor").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            cost = [len(x) // 6 + 1 for x in batch.column("words").to_pylist()]
            first = 0
            for i, name in enumerate(names):
                if size >= SHARD_WORDS and name != last:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    if (found := search(held)) is not None:
                        yield found
                    held, size, first = [], 0, i
                size += cost[i]
                last = name
            held.append(batch.slice(first))
        if held and (found := search(held)) is not None:
            yield found

    dealt = rows.select("anchor", "salt", "key1", "key2", "words", "weight").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, "key1 long, key2 long, mask long")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """Cuts segments into their windows: anchor, of1, of2 and bit (segment and place in it), key1, key2, words, weight."""

    def cut(batches):
        for batch in batches:
            words = _binary_words(batch.column("words"))
            n = words.count - window + 1
            which = np.repeat(np.arange(len(n)), n)
            bit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = words.first[which] + bit
            keys = [_stretch(words.hashes(), start, start + window, salt) for salt in (5, 11)]
            raw = words.raw.tobytes()
            texts = [raw[a:b] for a, b in zip(words.start[start].tolist(), words.end[start + window - 1].tolist(), strict=True)]
            rest = [batch.column(c).take(pa.array(which)) for c in ("anchor", "key1", "key2", "weight")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(bit), *(pa.array(k.view(np.int64)) for k in keys), pa.array(texts, pa.binary())], names=["anchor", "of1", "of2", "weight", "bit", "key1", "key2", "words"])

    return rows.select("anchor", "key1", "key2", "weight", "words").mapInArrow(cut, "anchor long, of1 long, of2 long, weight long, bit long, key1 long, key2 long, words binary")


def repeats(texts: DataFrame, window: int, anchor_bits: int = ANCHOR_BITS, common: int = COMMON, heavy: int = HEAVY) -> DataFrame:
    """texts: digest, text, weight. Settled: digest and its repeated windows, as (at, mask) of segments."""
    anchors = settle(_counted(texts, window).where("n > 1"), "anchors")
    often, hot, windows = anchors.where(F.col("segments") > common), None, None
    if not often.isEmpty():
        hot = _bitmap(often.select(F.col("anchor").alias("key")), COMMON_BITS)
        windows = _bitmap(_window_counts(texts, window, hot).where("n > 1"), WINDOW_BITS)
    bitmap = _bitmap(anchors.select(F.col("anchor").alias("key")), anchor_bits)
    segments = settle(_segments(texts, window, bitmap, anchor_bits, hot, windows), "segments")
    distinct = settle(segments.groupBy("anchor", "key1", "key2", "words").agg(F.sum("weight").alias("weight")), "distinct")
    many = settle(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("anchor"), "heavy")
    zero = F.lit(0).cast("long").alias("salt")
    split = not many.isEmpty()
    light = distinct.join(many, "anchor", "left_anti") if split else distinct
    masks = settle(_searched(light.select("anchor", zero, "key1", "key2", "words", "weight"), window), "masks")
    if split:
        cut = settle(_windows(distinct.join(many, "anchor", "left_semi"), window), "windows")
        own = cut.groupBy("anchor", "key1", "key2", "words").agg(F.sum("weight").alias("weight")).withColumn("salt", F.pmod(F.col("key1"), F.lit(1 << 20)))
        twice = _searched(own, window).select("key1", "key2")
        more = cut.join(twice, ["key1", "key2"], "left_semi").groupBy("of1", "of2").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("mask"))
        masks = settle(masks.unionAll(more.select(F.col("of1").alias("key1"), F.col("of2").alias("key2"), "mask")), "masks")
    hits = segments.select("key1", "key2", "digest", "at").join(masks, ["key1", "key2"])
    hits = settle(hits.groupBy("digest").agg(F.collect_list(F.struct("at", "mask")).alias("windows")), "hits")
    drop(anchors, segments, distinct, many, masks)
    return hits


def _distinct(rows: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """digest, text and weight of each different text, and the settled part of them; rows whose text cannot have a copy come straight from their scan."""
    flagged = within(rows.select("digest", "text"), copies, F.xxhash64("digest"), TEXT_BITS)
    several = settle(flagged.where("flag").groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("weight")), "several")
    return flagged.where("NOT flag").select("digest", "text", F.lit(1).cast("long").alias("weight")).unionAll(several), several


def removed(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", anchor_bits: int = ANCHOR_BITS, common: int = COMMON, heavy: int = HEAVY) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, intervals of removed words, and the kept words joined by one space (kept, kept_sha256)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    copies = settle(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    texts, several = _distinct(rows.where("text != ''"), copies)
    hits = repeats(texts, window, anchor_bits, common, heavy)
    drop(several)
    flagged = within(rows, hits, F.xxhash64("digest"), TEXT_BITS)
    some = join_dealt(flagged.where("flag").drop("flag"), hits, ["digest"], "doc_id", parts_of(copies, ["digest"]), "left").select("doc_id", "text", "windows")
    none = flagged.where("NOT flag").select("doc_id", "text", F.lit(None).cast(hits.schema["windows"].dataType).alias("windows"))

    def clear(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                words = Words(part.column("text"), BLANK)
                edges = np.zeros(len(words.start) + 1, np.int64)
                marks = part.column("windows")
                places, mask = marks.flatten().flatten()
                n_marks, n_places = np.asarray(marks.value_lengths().fill_null(0)), np.asarray(places.value_lengths())
                at = np.asarray(places.flatten()) + np.repeat(np.repeat(words.first[:-1], n_marks), n_places)
                mask = np.repeat(np.asarray(mask), n_places)
                for b in range(63):
                    own = at[(mask >> b) & 1 == 1] + b
                    edges += np.bincount(own, minlength=len(edges)) - np.bincount(own + window, minlength=len(edges)) if len(own) else 0
                gone = np.cumsum(edges)[:-1] > 0
                total = np.r_[0, np.cumsum(gone)][words.first]
                kept, ends = _kept(words, ~gone)
                texts = [kept[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                turns = np.flatnonzero(np.r_[True, gone[1:] != gone[:-1]]) if len(gone) else np.empty(0, np.int64)
                spans: list[list] = [[] for _ in texts]
                cuts = np.unique(np.r_[turns, words.first[:-1]]).astype(np.int64)
                cuts = cuts[cuts < len(gone)]
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(gone)], strict=True):
                    if gone[a]:
                        d = int(np.searchsorted(words.first, a, side="right")) - 1
                        spans[d].append({"start": a - int(words.first[d]), "end": b - int(words.first[d])})
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(words.count), pa.array(np.diff(total)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ], names=["doc_id", "n_words", "n_removed", "intervals", "kept", "kept_sha256"])

    return some.unionAll(none).mapInArrow(clear, "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept string, kept_sha256 string")


def _kept(words: Words, keep: np.ndarray) -> tuple[bytes, list[int]]:
    """The kept words of all texts, joined by one space within each, and where each text ends."""
    buffer, mask = np.r_[words.raw, np.uint8(0)], np.zeros(len(words.raw) + 2, np.int32)
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    follows = np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.empty(0, bool)
    mask[start] += 1
    np.add.at(mask, end + follows, -1)
    inside = np.cumsum(mask)[: len(buffer)] > 0
    buffer[end[follows]] = 32
    total = np.r_[0, np.cumsum(inside)]
    return buffer[inside].tobytes(), total[words.offsets].tolist()
