"""Merging runs: which are due, which overlap, and which tombstones may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.runs import level_of, stats
from tidelog.operators.state import latest, newest
from tidelog.sources import folder

#: Tables beyond which level 0, and any other, is merged; runs that a deep merge takes.
LEVEL0, DEEP, TAKE = 4, 10, 5
#: Buckets of keys that ranges are dealt to.
BUCKETS = 256


def merge_dropping_all(log: DataFrame) -> DataFrame:
    """The newest row of each key, without tombstones: right only at the bottom level."""
    return latest(log)


def merge_dropping_covered(log: DataFrame) -> DataFrame:
    """A tombstone goes only if every merged run holds its key."""
    n = F.broadcast(log.agg(F.count_distinct("run").alias("n")))
    best = log.groupBy("k").agg(F.max(F.struct("seq", "v", "del")).alias("best"), F.count_distinct("run").alias("held"))
    return best.join(n, F.col("held") <= F.col("n")).where(~F.col("best.del") | (F.col("held") < F.col("n"))).select("k", "best.v", "best.seq", "best.del")


def expired(log: DataFrame, hours: int = 24) -> DataFrame:
    """The newest row of each key, without tombstones that were written this long before the newest row of all (at: when a row was written)."""
    now = F.broadcast(log.agg(F.max("at").alias("now")))
    best = newest(log.select("k", "v", "seq", "del", "at"))
    old = F.col("del") & (F.col("at") <= F.col("now") - F.expr(f"INTERVAL {hours} HOURS"))
    return best.join(now, F.col("at") <= F.col("now")).where(~old).select("k", "v", "seq", "del")


def merge_oldest(log: DataFrame) -> DataFrame:
    """Merges the oldest runs, without tombstones."""
    oldest = log.select("run").distinct().orderBy("run").limit(TAKE)
    return latest(log.join(F.broadcast(oldest), "run", "left_semi"))


def merge_safely(log: DataFrame, upper: F.Column) -> DataFrame:
    """Merges the upper runs, tombstones kept while older runs lie below, and reads the result over what was left."""
    merged = newest(log.where(upper).select("k", "v", "seq", "del"))
    return latest(merged.unionByName(log.where(~upper).select("k", "v", "seq", "del")))


def resurrected(log: DataFrame, upper: F.Column, lower: F.Column) -> DataFrame:
    """Keys that come back if the upper runs drop their tombstones above the lower ones."""
    low, high = log.where(lower), log.where(upper)
    careless = latest(merge_dropping_all(high).withColumn("del", F.lit(False)).unionByName(low.select("k", "v", "seq", "del")))
    dead = newest(low.unionByName(high).select("k", "seq", "del")).where("del")
    return careless.join(dead.select("k"), "k", "left_semi").select("k")


def due(log: DataFrame, newest_level0: int) -> DataFrame:
    """level, its tables and whether it is to be merged."""
    levels = log.select("run").distinct().groupBy(level_of(F.col("run"), newest_level0).alias("level")).agg(F.count("*").alias("n_tables"))
    most = F.when(F.col("level") == 0, LEVEL0).otherwise(DEEP)
    return levels.select("level", "n_tables", (F.col("n_tables") > most).alias("due"))


def _bounds(ranges: DataFrame) -> list[str]:
    """At most ``BUCKETS`` keys that cut the ranges' least keys about evenly: a sample in the order of its hash."""
    some = ranges.select("min_key").distinct().orderBy(F.xxhash64("min_key"), "min_key").limit(BUCKETS)
    return sorted(r.min_key for r in some.collect())


def _bucket(key: F.Column, bounds: list[str]) -> F.Column:
    """The number of bounds at or below a key."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)


def _ranges(log: DataFrame) -> DataFrame:
    """Least and greatest key of each run, settled: a manifest."""
    path = folder.scratch(log.sparkSession, "manifest")
    stats(log).select("run", "min_key", "max_key").write.parquet(path)
    return log.sparkSession.read.schema("run long, min_key string, max_key string").parquet(path)


def overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of runs of two levels whose key ranges meet.

    An equality join: a range is dealt to each bucket of keys that it meets, and a pair counts in the bucket where its overlap begins.
    """
    first, second = _ranges(upper), _ranges(lower)
    bounds = _bounds(second)
    dealt = lambda df, side: df.select(F.col("run").alias(f"{side}_run"), F.col("min_key").alias(f"{side}0"), F.col("max_key").alias(f"{side}1"), F.explode(F.sequence(_bucket(F.col("min_key"), bounds), _bucket(F.col("max_key"), bounds))).alias("bucket"))
    met = dealt(first, "upper").join(dealt(second, "lower"), "bucket").where(F.greatest("upper0", "lower0") <= F.least("upper1", "lower1"))
    return met.where(F.col("bucket") == _bucket(F.greatest("upper0", "lower0"), bounds)).select("upper_run", "lower_run")


def remaining(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Runs of the lower level that no run of the upper one meets."""
    return lower.select("run").distinct().join(overlaps(upper, lower).select(F.col("lower_run").alias("run")).distinct(), "run", "left_anti")


def keys_in_all(log: DataFrame) -> DataFrame:
    """Keys that every run holds."""
    n = F.broadcast(log.agg(F.count_distinct("run").alias("n")))
    return log.groupBy("k").agg(F.count_distinct("run").alias("n")).join(n, "n").select("k")


def candidates(log: DataFrame, probes: DataFrame) -> DataFrame:
    """k and the number of runs whose key range holds it: ranges begun at or before it, less those ended before it.

    Both are running counts over the union of ends and probes, within buckets of keys and over the buckets' totals.
    """
    ranges = _ranges(log)
    bounds = _bounds(ranges)
    ends = ranges.select(F.explode(F.array(F.struct(F.col("min_key").alias("k"), F.lit(0).alias("kind"), F.lit(1).alias("n")), F.struct(F.col("max_key").alias("k"), F.lit(2).alias("kind"), F.lit(-1).alias("n")))).alias("end")).select("end.*")
    rows = ends.unionAll(probes.select("k", F.lit(1).alias("kind"), F.lit(0).alias("n")).distinct()).withColumn("bucket", _bucket(F.col("k"), bounds))
    totals = rows.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("bucket").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).where("kind = 1").join(F.broadcast(before), "bucket").select("k", (F.col("own") + F.col("before")).alias("n_runs"))
