"""State of a log: last writer wins, then tombstones go. Never the other way round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that an entry costs beyond its key and value.
ENTRY_BYTES = 16
#: Request lists of up to this estimated size are broadcast to prune the log before it is merged.
BROADCAST_BYTES = 8 << 20


def newest(log: DataFrame, *keys: str) -> DataFrame:
    """One row a key, that of the greatest seq, tombstones included.

    A max over a struct combines before the shuffle, so a hot key costs a row a task.
    """
    keys = keys or ("k",)
    rest = [c for c in log.columns if c not in (*keys, "seq")]
    best = log.groupBy(*keys).agg(F.max(F.struct("seq", *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in ("seq", *rest)))


def latest(log: DataFrame) -> DataFrame:
    """k, v, seq of live keys."""
    return newest(log.select("k", "v", "seq", "del")).where("NOT del").select("k", "v", "seq")


def latest_by_rank(log: DataFrame) -> DataFrame:
    """The same through a ranking; Spark keeps one row a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq")))
    return log.withColumn("rank", rank).where("rank = 1 AND NOT del").select("k", "v", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """One row (k, v); v is null for an absent or deleted key. The key reaches the scan as a filter."""
    spark = log.sparkSession
    found = latest(log.where(F.col("k") == key)).select("k", "v")
    return spark.createDataFrame([(key,)], "k string").join(F.broadcast(found), "k", "left")


def _fits(rows: DataFrame) -> bool:
    """Whether the optimizer's own estimate, from file sizes, allows a broadcast. Costs no job."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES


def _asked(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live state, of the requested keys only where their list is short."""
    if _fits(wanted):
        log = log.join(F.broadcast(wanted.select("k").distinct()), "k", "left_semi")
    return latest(log).select("k", "v")


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """pos, k, v of each request, duplicates and misses kept."""
    return wanted.join(_asked(log, wanted), "k", "left").select("pos", "k", "v")


def present(log: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(_asked(log, wanted), "k", "left_semi").select("pos", "k")


def absent(log: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(_asked(log, wanted), "k", "left_anti").select("pos", "k")


def multi_set(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Live state after a batch of newer mutations; the last of a key's duplicates wins."""
    return latest(log.select("k", "v", "seq", "del").unionByName(batch.select("k", "v", "seq", "del")))


def deleted(log: DataFrame) -> DataFrame:
    return newest(log.select("k", "seq", "del")).where("del").select("k", "seq")


def memory_usage(log: DataFrame) -> DataFrame:
    """Bytes ever written."""
    return log.agg(F.coalesce(F.sum(F.octet_length("k") + F.octet_length("v") + ENTRY_BYTES), F.lit(0)).cast("long").alias("bytes"))


def op_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("run").agg(F.count(F.when(~F.col("del"), 1)).alias("n_set"), F.count(F.when(F.col("del"), 1)).alias("n_del"))


def seeded(log: DataFrame) -> DataFrame:
    """Live state with the row that a fresh store holds."""
    seed = log.sparkSession.createDataFrame([("system:version", "1.0", 0)], "k string, v string, seq long")
    return latest(log).unionByName(seed)


def operations(log: DataFrame) -> DataFrame:
    """seq and a line for each mutation, as an operation log prints it."""
    return log.select("seq", F.concat(F.lit("[LOG] "), F.when(F.col("del"), F.concat(F.lit("DEL "), "k")).otherwise(F.concat(F.lit("SET "), "k", F.lit(" "), "v"))).alias("line"))


def layered(log: DataFrame) -> DataFrame:
    """k, v and the layer (memtable, L0, L1) that a read finds each live key in; layers are unions of runs by age."""
    top = log.agg(F.max("run").alias("top"))
    layer = F.when(F.col("run") == F.col("top"), "memtable").when(F.col("run") >= F.col("top") - 4, "L0").otherwise("L1")
    best = newest(log.select("k", "seq", "v", "del", "run")).where("NOT del")
    return best.crossJoin(F.broadcast(top)).select("k", "v", layer.alias("layer"))


def history(log: DataFrame) -> DataFrame:
    """k, seq, prev_seq and next_seq of each version."""
    by = Window.partitionBy("k").orderBy("seq")
    return log.select("k", "seq", F.lag("seq").over(by).alias("prev_seq"), F.lead("seq").over(by).alias("next_seq"))


def sorted_scan(log: DataFrame, n: int) -> DataFrame:
    """The first n live keys in byte order."""
    return latest(log).select("k", "v").orderBy("k").limit(n)


def range_scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Live keys from low to high, both included; the bounds reach the scan."""
    return latest(log.where(F.col("k").between(low, high))).select("k", "v")
