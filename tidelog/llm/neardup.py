"""MinHash near-dedup: links documents whose shingle sets are alike, and groups them.

1. Each text becomes the set of its distinct shingles (64-bit hashes), many
   universal-hash minima of it, and one key for each band of minima.
2. Documents of equal sets form a class by aggregation; one stands for it.
3. In each bucket (documents that share a band's key) every member is compared
   with the least one: minima first, then the full sets of those that are
   left. Members stream past the centre, so a bucket of any size needs the
   memory of two documents, and its stream is dealt to as many tasks as its
   size asks for.
4. Verified links become components (large-star, small-star).
5. Buckets that still hold several components are searched for the links that
   step 3 did not try: members of all but the bucket's largest component stream
   past each block of its members, minima first, then the full sets of those
   that are left, skipping pairs already connected and pairs that an earlier
   band brings together; new links join components.

A link is missed only if no band of minima agrees: at similarity 0.85 with 25
bands of 5, once in two million; no bucket is capped.

Defined results: null and empty texts and texts without words have empty sets,
linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows are alike and share a component; a null doc_id is never a
component's name unless all of a component lack one (then null, kept false);
an empty table gives an empty result. Other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shared import drop, join_dealt, parts_of, settle, within
from tidelog.llm.words import BLANK_LOWER, U64, Words, mix, ngrams, steps

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Share of equal minima below which full sets are not compared: six deviations under the threshold.
SLACK = 6.0
#: Members of a bucket in one stream, and in one block of step 5; members that are compared with a block at once.
STREAM, BLOCK, AT_ONCE = 256, 256, 64
#: Parts that a bucket's members are dealt to where they meet the list of mixed buckets.
SALTS = 16
_LAST = (1 << 63) - 1
#: Bits of the filter that keeps texts which no candidate needs out of the shuffle; 4 MB when full.
FILTER_BITS = 1 << 25


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5381)
    return rng.integers(0, 1 << 63, HASHES, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, HASHES, dtype=U64)


def shingles(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(column, BLANK_LOWER)
    h = words.hashes()
    every = ngrams(h, size)
    out = []
    for first, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(every[first : first + n - size + 1]))
        elif n:
            out.append(mix(ngrams(h[first : first + n], n) ^ U64(n)))
        else:
            out.append(np.empty(0, U64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each universal hash over each set, as a row of HASHES numbers; empty sets give zeros.

    Equal sets give equal rows. Of each number one byte is kept beside the band keys: that can only raise agreement.
    """
    out = np.zeros((len(sets), HASHES), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        x = np.concatenate([sets[i] for i in some]) >> U64(32)
        start = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        for k, (a, b) in enumerate(zip(*_parameters(), strict=True)):
            y = x * a
            y += b
            out[some, k] = np.minimum.reduceat(y, start) >> U64(32)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15) + np.zeros((len(signature), 1), U64)
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    for r in range(ROWS):
        h = mix(h ^ rows[:, :, r]) * U64(0xD1342543DE82EF95)
    return h.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _least_equal(percent: int) -> int:
    p = percent / 100
    return max(1, int(HASHES * p - SLACK * (HASHES * p * (1 - p)) ** 0.5))


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Settled: a number for each row, its id, text and set: size, two keys of the whole set, minima, band keys; with ``carry`` the row itself."""
    others = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")] if carry else []
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *others)
    names = [*rows.columns, "n", "key1", "key2", "minima", "bands"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", n long, key1 long, key2 long, minima binary, bands array<long>"

    def sign(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                sets = shingles(part.column("text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                sign_ = minima(sets)
                key1 = np.array([mix(s).sum(dtype=U64) for s in sets], U64).view(np.int64)
                key2 = np.array([np.bitwise_xor.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5))) for s in sets], U64).view(np.int64)
                bands = _bands(sign_)
                ends = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(key1), pa.array(key2), pa.array([x.tobytes() for x in sign_.astype(np.uint8)], pa.binary()), lists], names=names)

    return settle(rows.mapInArrow(sign, kind), "signatures", few=True)


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose rid is wanted, and few others."""
    return within(rows, wanted, F.xxhash64("rid"), FILTER_BITS).where("flag").drop("flag")


def _streams(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The centre of each stream, then its members, with columns of their rows."""
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("streams"))
    some = _only(rows.select("rid", *columns), pairs.select("rid").unionAll(pairs.select(F.col("centre").alias("rid"))))
    member = pairs.join(sizes, "centre").join(some, "rid").select("centre", F.pmod(F.xxhash64("rid"), F.col("streams")).cast("int").alias("stream"), F.lit(1).alias("kind"), "rid", *columns)
    centre = sizes.join(some, F.col("centre") == F.col("rid")).withColumn("stream", F.explode(F.sequence(F.lit(0), F.col("streams") - 1))).select("centre", "stream", F.lit(0).alias("kind"), "rid", *columns)
    return centre.unionAll(member).repartition("centre", "stream").sortWithinPartitions("centre", "stream", "kind")


def _star_links(pairs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (centre, rid) pairs, those whose sets are alike."""
    least = _least_equal(percent)

    def estimate(batches):
        own = name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sign_ = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint8).reshape(batch.num_rows, HASHES)
            marks = []
            for i, (kind, centre, rid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "centre", "rid")), strict=True)):
                if kind == 0:
                    own, name = sign_[i].copy(), centre
                elif name == centre and np.count_nonzero(sign_[i] == own) >= least:
                    marks.append((centre, rid))
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*marks, strict=True)], names=["centre", "rid"])

    def verify(batches):
        own_set = name = None
        for batch in batches:
            for part in steps(batch, "text"):
                marks = []
                for kind, centre, rid, own in zip(*(part.column(c).to_pylist() for c in ("kind", "centre", "rid")), shingles(part.column("text"), size), strict=True):
                    if kind == 0:
                        own_set, name = own, centre
                    elif name == centre and alike(own_set, own, percent):
                        marks.append((centre, rid))
                if marks:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*marks, strict=True)], names=["a", "b"])

    likely = settle(_streams(pairs, signed, "minima").mapInArrow(estimate, "centre long, rid long"), "likely", few=True)
    return _streams(likely, signed, "text").mapInArrow(verify, "a long, b long")


class _Cell:
    """A block of a bucket's members, past which members of smaller components stream."""

    def __init__(self, percent: int):
        self.least, self.percent = _least_equal(percent), percent
        self.key, self.parts = None, []

    def hold(self, rows: dict) -> None:
        self.parts.append(rows)

    def close(self) -> dict:
        if len(self.parts) > 1:
            self.parts = [{c: np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]}]
        return self.parts[0]

    def likely(self, rows: dict, band: int) -> tuple[np.ndarray, np.ndarray]:
        """(passing row, member of the block) of pairs whose minima agree enough; of two small ones, once."""
        own, found = self.close(), []
        for at in range(0, len(rows["rid"]), AT_ONCE):
            a = {c: v[at : at + AT_ONCE] for c, v in rows.items()}
            ok = (a["root"][:, None] != own["root"]) & (100 * np.minimum(a["n"][:, None], own["n"]) >= self.percent * np.maximum(a["n"][:, None], own["n"]))
            ok &= ~own["small"] | (a["rid"][:, None] < own["rid"])
            for k in range(band):
                ok &= a["bands"][:, k, None] != own["bands"][:, k]
            i, j = np.nonzero(ok)
            near = np.count_nonzero(a["minima"][i] == own["minima"][j], axis=1) >= self.least
            found.append((i[near] + at, j[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


CELL = "bucket long, cell long, kind int, rid long, root long, small boolean, n long, bands array<long>, minima binary"


def _cells(rows: DataFrame, run) -> DataFrame:
    """``run`` over each cell: rows of its members (kind 0), then of those that pass (kind 1), as (cell, kind, arrays, batch)."""

    def scan(batches):
        def cells():
            for batch in batches:
                names = ("bucket", "cell", "kind")
                key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if batch.num_rows else []
                for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                    part = batch.slice(a, b - a)
                    arrays = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "root", "small", "n")}
                    arrays["minima"] = np.frombuffer(b"".join(part.column("minima").to_pylist()), np.uint8).reshape(b - a, HASHES)
                    arrays["bands"] = part.column("bands").flatten().to_numpy().reshape(b - a, BANDS)
                    yield tuple(key[:, a].tolist()), arrays, part

        yield from run(cells())

    return rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "kind").mapInArrow(scan, run.schema)


def _band(bucket: int, arrays: dict) -> int:
    return int(np.flatnonzero(arrays["bands"][0] == bucket)[0])


def _estimate(percent: int):
    """Rows of cells that take part in a pair whose minima agree enough."""

    def run(cells):
        cell, hit, held = _Cell(percent), None, []

        def answer():
            for part, at in zip(held, np.split(hit, np.cumsum([p.num_rows for p in held])[:-1]), strict=True):
                if at.any():
                    yield part.filter(pa.array(at))

        for (*key, kind), arrays, part in cells:
            if key != cell.key:
                if hit is not None:
                    yield from answer()
                cell, hit, held = _Cell(percent), None, []
                cell.key = key
            if kind == 0:
                cell.hold(arrays)
                held.append(part)
                continue
            if not cell.parts:
                continue
            if hit is None:
                hit = np.zeros(len(cell.close()["rid"]), bool)
            i, j = cell.likely(arrays, _band(key[0], arrays))
            hit[j] = True
            if len(i):
                yield part.take(pa.array(np.unique(i)))
        if hit is not None:
            yield from answer()

    run.schema = CELL
    return run


def _verify(size: int, percent: int):
    """Links between components, as pairs of roots, of pairs whose sets are alike."""

    def run(cells):
        cell, sets, names = _Cell(percent), [], {}

        def find(x):
            while names.setdefault(x, x) != x:
                names[x] = names[names[x]]
                x = names[x]
            return x

        for (*key, kind), arrays, part in cells:
            if key != cell.key:
                cell, sets, names = _Cell(percent), [], {}
                cell.key = key
            if kind == 0:
                cell.hold(arrays)
                sets += shingles(part.column("text"), size)
                continue
            if not cell.parts:
                continue
            i, j = cell.likely(arrays, _band(key[0], arrays))
            own, roots, out, last, mine = None, cell.close()["root"].tolist(), [], -1, arrays["root"].tolist()
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = find(mine[x]), find(roots[y])
                if a == b:
                    continue
                if x != last:
                    own, last = shingles(part.column("text").slice(x, 1), size)[0], x
                if alike(own, sets[y], percent):
                    names[max(a, b)] = min(a, b)
                    out.append((mine[x], roots[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    run.schema = "a long, b long"
    return run


def _block_links(named: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components within a bucket; named: bucket, members, rid, root."""
    sizes = settle(named.groupBy("bucket", "root").agg(F.count("*").alias("k")), "roots", few=True)
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("roots")).where("roots > 1").select("bucket", F.col("most.root").alias("big"), F.ceil((F.col("all") - F.col("most.k")) / BLOCK).alias("parts"))
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = named.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS))).join(mixed, ["bucket", "salt"])
    rows = settle(rows.select("bucket", "rid", "root", (F.col("root") != F.col("big")).alias("small"), "parts", F.ceil(F.col("members") / BLOCK).alias("blocks")), "mixed", few=True)
    rows = rows.join(_only(signed.select("rid", "n", "bands", "minima"), rows), "rid")
    # A cell is a block of members and a part of those that pass.
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = rows.withColumn("part", numbers("parts")).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).withColumn("kind", F.lit(0))
    past = rows.where("small").withColumn("part", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("parts"))).withColumn("block", numbers("blocks")).withColumn("kind", F.lit(1))
    own, past = (x.withColumn("cell", F.col("block") * F.col("parts") + F.col("part")) for x in (own, past))
    columns = ["bucket", "cell", "kind", "rid", "root", "small", "n", "bands", "minima"]
    likely = settle(_cells(own.select(columns).unionAll(past.select(columns)), _estimate(percent)), "likely", few=True)
    return _cells(likely.join(_only(signed.select("rid", "text"), likely), "rid").select(*columns, "text"), _verify(size, percent))


def groups(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept; with ``carry`` also rid, text, row and ``first`` (one row of each component).

    Links texts with 100 * intersection >= percent * union of their sets of ``size``-word shingles.
    """
    signed = signatures(docs, size, id_col, text_col, carry)
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.col("rid"))).alias("best")
    classes = settle(signed.where("n > 0").groupBy("key1", "key2", "n").agg(F.min("rid").alias("node"), best, F.count("*").alias("copies")), "classes", few=True)
    stands = signed.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
    banded = settle(stands.select("rid", F.explode("bands").alias("bucket")), "bands", few=True)

    buckets = banded.groupBy("bucket").agg(F.min("rid").alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = settle(banded.join(buckets, "bucket"), "shared", few=True)
    pairs = settle(shared.where("rid != centre").select("centre", "rid").distinct(), "pairs", few=True)
    roots = components(_star_links(pairs, signed, size, percent))
    drop(banded, pairs)

    named = shared.where("members > 2").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("bucket", "members", "rid", F.coalesce("root", "rid").alias("root"))
    more = settle(_block_links(named, signed, size, percent), "links", few=True)
    drop(shared)
    if not more.isEmpty():
        upper = components(more)
        every = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        roots = settle(every.unionAll(upper), "roots", few=True)

    joined = classes.join(roots, "node", "left").select("node", "key1", "key2", F.col("n").alias("size"), "best", F.coalesce("root", "node").alias("root"))
    least = settle(joined.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n")), "least", few=True)
    named = join_dealt(joined, least.drop("n"), ["root"], "node", parts_of(least, ["root"])).select("key1", "key2", F.col("size").alias("n"), "least")
    extra = ["rid", "text", "row"] if carry else []
    full = join_dealt(signed.where("n > 0").select("doc_id", "rid", "n", "key1", "key2", *extra[1:]), named, ["key1", "key2", "n"], "rid", parts_of(classes, ["key1", "key2", "n"], "copies"))
    full = full.select("doc_id", "n", F.when(F.col("least.doc") != _LAST, F.col("least.doc")).alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("first"), *extra)
    none = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"), *extra)
    out = full.unionAll(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "first", *extra)
    return out if carry else out.drop("first")


def dedup(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, one of each component (of the smallest doc_id)."""
    rows = groups(docs, size=size, percent=percent, id_col=id_col, text_col=text_col, carry=True).where("first")
    return rows.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
