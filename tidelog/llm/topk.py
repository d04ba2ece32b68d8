"""Exact top-k inner products by block-at-a-time pruning.

Vectors are dealt by a hash of their id to shards. A shard orders its vectors
so that near ones follow each other, cuts them into blocks of consecutive
rows, and keeps the greatest and least value of each term in each block. A
query's bound on a block is the sum over its terms of what those extremes
allow; blocks are taken in descending order of bound and scored through their
forward index (the block's own rows) until the next bound is below the kth
score so far. What a shard finds is exact, so the best of all shards is too.

Queries stream past a shard in blocks; a worker holds one shard and one block
of queries. Shards grow with the table up to ``SHARD_ROWS`` and are many
enough before that to keep all cores busy.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id; shorter vectors count as padded with
zeros; repeated rows are candidates each, but one query (the least vector,
should they differ); a query's own id is no candidate; ties go to the smaller
id; fewer candidates than k are all returned; an empty table gives an empty
result. Scores are exact at every magnitude: in floating point where no sum
can pass 2**53, in 64-bit integers up to 2**63, beyond that in integers of any
length. A scaled component, or a score among a shard's best, that does not fit
a long raises an error that says so.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, LEAST_SHARD_ROWS, LEAST_SHARDS = 1 << 16, 1 << 10, 32
BLOCK_ROWS, QUERY_BLOCK, AT_ONCE = 64, 256, 4
_LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of the components, packed (the width of an integer, then the integers), of (vec_id, x) that take part."""

    def pack(batches):
        for batch in batches:
            lists = batch.column("x")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            n = np.diff(np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            ends = np.cumsum(n)
            ok = ~np.asarray(lists.is_null())
            bad = np.flatnonzero(~np.isfinite(values))
            ok[np.searchsorted(ends, bad, side="right")] = False
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * np.where(np.repeat(ok, n), values, 0))
            if len(whole) and np.abs(whole).max() >= _LONG:
                raise ValueError("a scaled component does not fit a long")
            whole = whole.astype("<i8")
            most = np.maximum.reduceat(np.r_[np.abs(whole), 0], np.minimum(ends - n, len(whole))) if len(n) else n
            width = np.select([n == 0, most < 1 << 15, most < 1 << 31], [2, 2, 4], 8)
            packed = [bytes([w]) + whole[e - k : e].astype(f"<i{w}").tobytes() if o else None for e, k, o, w in zip(ends.tolist(), n.tolist(), ok, width.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "x"])
            yield out.filter(pa.array(ok))

    return vectors.mapInArrow(pack, "vec_id long, x binary")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for i, p in enumerate(packed):
        row = np.frombuffer(p, f"<i{p[0]}", offset=1)
        out[i, : len(row)] = row
    return out


class Shard:
    """Blocks of one shard's rows, their term extremes and forward indexes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block_rows: int = BLOCK_ROWS):
        centres = x[:: max(1, len(x) // 64)][:64].astype(np.float64)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1)
        near = x @ centres.T
        group = near.argmax(axis=1)
        order = np.lexsort((ids, -near[np.arange(len(x)), group], group))
        self.ids, self.x, self.block_rows = ids[order], x[order], block_rows
        self.size = np.abs(self.x).max(axis=1, initial=0)
        cuts = np.arange(0, len(x), block_rows)
        self.most = np.maximum.reduceat(self.x, cuts, axis=0).astype(np.float64)
        self.least = np.minimum.reduceat(self.x, cuts, axis=0).astype(np.float64)
        self.scored = 0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, vec_id, score) of each query's k best rows here."""
        width, largest = self.x.shape[1], int(self.size.max(initial=0))
        reach = [largest * int(m) * width for m in np.abs(queries).max(axis=1, initial=0)]
        q = queries.astype(np.float64)
        bounds = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
        if max(reach) >= 1 << 53:  # what rounding may have taken off
            bounds += np.abs(q) @ np.maximum(np.abs(self.most), np.abs(self.least)).T * (width * 2.0**-50)
        x = self.x.astype(np.float64) if min(reach) < 1 << 53 else self.x
        for i, name in enumerate(ids.tolist()):
            order = np.argsort(-bounds[i], kind="stable")
            best_id, best = np.empty(0, np.int64), np.empty(0, np.int64)
            for at in range(0, len(order), AT_ONCE):
                some = order[at : at + AT_ONCE]
                if len(best) == k:
                    some = some[bounds[i, some] >= float(best[-1])] if reach[i] < 1 << 53 else some[[bound >= best[-1] for bound in bounds[i, some].tolist()]]
                    if not len(some):
                        break
                rows = (some[:, None] * self.block_rows + np.arange(self.block_rows)).ravel()
                rows = rows[rows < len(x)]
                self.scored += len(rows)
                if reach[i] < 1 << 53:
                    score = (x[rows] @ q[i]).astype(np.int64)
                else:
                    score = self.x[rows] @ queries[i] if reach[i] < _LONG else self._any_length(rows, queries[i])
                own = self.ids[rows]
                others = own != name
                best = np.concatenate([best, score[others]])
                best_id = np.concatenate([best_id, own[others]])
                top = np.lexsort((best_id, -best))[:k] if best.dtype != object else sorted(range(len(best)), key=lambda j: (-best[j], best_id[j]))[:k]
                best, best_id = best[top], best_id[top]
            if reach[i] >= _LONG and any(not -_LONG <= s < _LONG for s in best.tolist()):
                raise ValueError(f"a score of query {name} does not fit a long")
            yield from ((name, v, s) for v, s in zip(best_id.tolist(), best.tolist(), strict=True))

    def _any_length(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores as Python integers; rows whose sums cannot leave a long are scored together."""
        out = np.empty(len(rows), object)
        small = self.size[rows] <= (_LONG - 1) // (int(np.abs(query).max()) * len(query))
        out[small] = (self.x[rows[small]] @ query).tolist()
        q = query.tolist()
        out[~small] = [sum(a * b for a, b in zip(row, q, strict=True)) for row in self.x[rows[~small]].tolist()]
        return out


def search(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, vec_id, score) of each query's k best rows here."""
        if float(np.abs(self.x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * self.x.shape[1] < 2**53:
            x, q = self.x.astype(np.float64), queries.astype(np.float64)
            most, least = self.most.astype(np.float64), self.least.astype(np.float64)
        else:
            x, q, most, least = self.x, queries, self.most, self.least
        bounds = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
        for i, name in enumerate(ids.tolist()):
            order = np.argsort(-bounds[i], kind="stable")
            best_id, best = np.empty(0, np.int64), np.empty(0, np.int64)
            for at in range(0, len(order), AT_ONCE):
                some = order[at : at + AT_ONCE]
                if len(best) == k:
                    some = some[bounds[i, some] >= best[-1]]
                    if not len(some):
                        break
                rows = (some[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
                rows = rows[rows < len(x)]
                self.scored += len(rows)
                score, own = (x[rows] @ q[i]).astype(np.int64), self.ids[rows]
                others = own != name
                best = np.concatenate([best, score[others]])
                best_id = np.concatenate([best_id, own[others]])
                top = np.lexsort((best_id, -best))[:k]
                best, best_id = best[top], best_id[top]
            yield from ((name, v, s) for v, s in zip(best_id.tolist(), best.tolist(), strict=True))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, least_shard_rows: int = LEAST_SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: for each query its k rows of greatest integer inner product."""
    n = vectors.count()
    shards = max(-(-n // shard_rows), min(LEAST_SHARDS, -(-n // least_shard_rows)), 1)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = quantised(pick(vectors), scale).select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "x")
    able = pick(queries).where("forall(x, e -> e IS NOT NULL AND abs(e) < double('Infinity'))")
    asked = quantised(able.groupBy("vec_id").agg(F.min("x").alias("x")), scale)
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "x")
    dealt = rows.unionAll(asked).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id")

    def run(batches):
        held: tuple[list, list] = ([], [])
        asking: tuple[list, list] = ([], [])
        shard, now = None, None

        def answer():
            nonlocal shard
            if asking[0] and held[0]:
                width = max((len(p) - 1) // p[0] for p in chain(held[1], asking[1]))
                if shard is None or shard.x.shape[1] < width:
                    shard = Shard(np.array(held[0], np.int64), _matrix(held[1], width), block_rows)
                found = list(shard.search(np.array(asking[0], np.int64), _matrix(asking[1], shard.x.shape[1]), k))
                asking[0].clear(), asking[1].clear()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])
            asking[0].clear(), asking[1].clear()

        for batch in batches:
            for name, kind, vec_id, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "vec_id", "x")), strict=True):
                if name != now:
                    yield from answer()
                    held[0].clear(), held[1].clear()
                    shard, now = None, name
                to = asking if kind else held
                to[0].append(vec_id)
                to[1].append(x)
                if len(asking[0]) == QUERY_BLOCK:
                    yield from answer()
        yield from answer()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
