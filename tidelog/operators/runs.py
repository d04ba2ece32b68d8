"""Runs: what a flush writes, and what is known of it without reading it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import poly31
from tidelog.operators.state import ENTRY_BYTES, newest

SHARDS = 16
FENCE = 16
#: Runs whose totals are summed before they are ordered globally.
GROUP = 1024


def collapse(log: DataFrame) -> DataFrame:
    """Each run's memtable when it is flushed: the newest row of each key."""
    return newest(log.select("run", "k", "v", "seq", "del"), "run", "k").select("run", "k", "v", "seq", "del")


def sharded(log: DataFrame) -> DataFrame:
    return log.withColumn("shard", poly31(F.col("k"), SHARDS))


def flush_boundaries(log: DataFrame, limit: int) -> DataFrame:
    """seq, k and the flush that takes each mutation, by running bytes over the whole log.

    Running sums within runs, within groups of runs and over groups: only the groups' totals (a row for ``GROUP`` runs) are ordered globally.
    """
    sized = log.select("run", "seq", "k", (F.octet_length("k") + F.octet_length("v")).cast("long").alias("size"))
    totals = sized.groupBy("run").agg(F.sum("size").alias("total")).withColumn("group", F.floor(F.col("run") / GROUP))
    groups = totals.groupBy("group").agg(F.sum("total").alias("all"))
    before = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("before"))
    own = F.sum("total").over(Window.partitionBy("group").orderBy("run")) - F.col("total")
    offsets = totals.join(before, "group").select("run", (own + F.col("before")).alias("offset"))
    within = F.sum("size").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    running = sized.withColumn("within", within).join(offsets, "run")
    return running.select("seq", "k", F.floor((F.col("within") + F.col("offset")) / limit).alias("flush"))


def flushes(log: DataFrame, limit: int) -> DataFrame:
    """shard, seq, k and the flush that takes each mutation: a shard's memtable is closed before the entry that would pass the limit.

    An entry counts key, value and ``ENTRY_BYTES``; one that replaces an entry of the same memtable counts in its place.
    Rows stream past in order, shard by shard, so a worker holds the sizes of one memtable, which the limit bounds.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flush, held, sizes = None, 0, 0, {}
        for batch in batches:
            out = []
            for shard, k, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "k", "size")), strict=True):
                if shard != now:
                    now, flush, held, sizes = shard, 0, 0, {}
                if held + size > limit and sizes:
                    flush, held, sizes = flush + 1, 0, {}
                held += size - sizes.get(k, 0)
                sizes[k] = size
                out.append(flush)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "seq", "k")), pa.array(out, pa.int64())], names=["shard", "seq", "k", "flush"])

    rows = sharded(log).select("shard", "seq", "k", (F.octet_length("k") + F.octet_length("v") + ENTRY_BYTES).cast("long").alias("size"))
    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(close, "shard int, seq long, k string, flush long")


def empty_shards(log: DataFrame) -> DataFrame:
    """Each shard and whether its memtable holds nothing."""
    held = sharded(log).select("shard").distinct().withColumn("held", F.lit(True))
    every = log.sparkSession.range(SHARDS).select(F.col("id").cast("int").alias("shard"))
    return every.join(held, "shard", "left").select("shard", F.col("held").isNull().alias("empty"))


def stats(log: DataFrame) -> DataFrame:
    """A manifest row of each run: keys, bounds, tombstones, bytes."""
    return collapse(log).groupBy("run").agg(
        F.count("*").alias("n"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.when(F.col("del"), 1)).alias("n_tombstones"),
        F.sum(F.octet_length("k") + F.octet_length("v")).cast("long").alias("bytes"),
    )


def level_of(run: Column, newest_level0: int) -> Column:
    return F.when(run >= newest_level0, 0).otherwise(1)


def tree(log: DataFrame, newest_level0: int) -> DataFrame:
    """Tables, keys and bounds of each level."""
    return stats(log).groupBy(level_of(F.col("run"), newest_level0).alias("level")).agg(F.count("*").alias("n_tables"), F.sum("n").cast("long").alias("n_keys"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def shard_stats(log: DataFrame) -> DataFrame:
    """Keys and bytes of each shard's collapsed memtable."""
    return sharded(newest(log.select("k", "seq", "v"))).groupBy("shard").agg(F.count("*").alias("n_keys"), F.sum(F.octet_length("k") + F.octet_length("v") + ENTRY_BYTES).cast("long").alias("bytes"))


def fences(log: DataFrame) -> DataFrame:
    """Every sixteenth key of each run in byte order, with its position."""
    place = (F.row_number().over(Window.partitionBy("run").orderBy("k")) - 1).cast("long")
    return collapse(log).select("run", "k", place.alias("position")).where(F.col("position") % FENCE == 0)


def fence_lookup(log: DataFrame, probes: DataFrame) -> DataFrame:
    """run, k and the position of the greatest fence at or before each probe key, 0 before the first: an as-of join by union and window."""
    marks = fences(log)
    asked = probes.select("k").distinct().join(marks.select("run").distinct(), F.lit(True)).select("run", "k", F.lit(None).cast("long").alias("position"), F.lit(1).alias("probe"))
    rows = marks.select("run", "k", "position", F.lit(0).alias("probe")).unionAll(asked)
    last = F.last("position", ignorenulls=True).over(Window.partitionBy("run").orderBy("k", "probe").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("fence", F.coalesce(last, F.lit(0).cast("long"))).where("probe = 1").select("run", "k", "fence")


def bloom_parameters(log: DataFrame, *by: str, segments: int = 1) -> DataFrame:
    """Filter sizes of each run: 10 bits a key and 7 hashes, or for one false positive in a hundred (1024 bits and 2 to 20 hashes at least)."""
    by = by or ("run",)
    n = F.col("n") if segments == 1 else F.floor((F.col("n") + segments - 1) / segments)
    bits = F.floor(n * (-math.log(0.01) / math.log(2) ** 2))
    hashes = F.least(F.greatest(F.floor(bits * math.log(2) / n), F.lit(2)), F.lit(20))
    return collapse(log).groupBy(*by).agg(F.count("*").alias("n")).select(
        *by, "n", (F.col("n") * 10).alias("a_bits"), F.lit(7).cast("long").alias("a_hashes"), F.greatest(bits, F.lit(1024)).cast("long").alias("b_bits"), hashes.cast("long").alias("b_hashes"),
    )


def common_prefix(log: DataFrame) -> DataFrame:
    """run, k, the prefix that all keys of the run share, and what is left of the key.

    The prefix of the least and the greatest key is that of all between.
    """
    ends = log.groupBy("run").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    size = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("a"), F.length("b"))), lambda i: F.substring(F.col("a"), F.lit(1), i) == F.substring(F.col("b"), F.lit(1), i)))
    prefixes = ends.select("run", F.substring(F.col("a"), F.lit(1), size).alias("prefix"))
    return collapse(log).join(prefixes, "run").select("run", "k", "prefix", F.substring("k", F.length("prefix") + 1, F.length("k")).alias("suffix"))
