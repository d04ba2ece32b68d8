"""What a least-recently-used cache holds, as a ranking by last access."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import cache_segment


def lru(log: DataFrame, capacity: int) -> DataFrame:
    """k, last_seq and place of the cached keys, newest first. A SET is an access; a DEL takes its key out and frees its place.

    Only the ``capacity`` live keys of the newest accesses can be in the cache. One of them was evicted if at any time
    since its access as many keys lay above it as the cache holds; keys above come with a first SET and go with a DEL.
    So the log since the oldest of these accesses meets at most ``capacity`` keys, each in a window of its own.
    """
    last = log.groupBy("k").agg(F.max(F.struct("seq", "del")).alias("last"))
    top = last.where("NOT last.del").select("k", F.col("last.seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(capacity)
    start = F.broadcast(top.agg(F.min("last_seq").alias("start")))
    since = log.join(start, F.col("seq") > F.col("start")).select("k", "seq", "del")
    own = Window.partitionBy("k").orderBy("seq")
    since = since.select("seq", "del", F.lag("seq").over(own).alias("prior"), F.lag("del").over(own).alias("gone"))
    held = F.col("prior").isNotNull() & (F.col("prior") > F.col("last_seq")) & ~F.col("gone")
    change = F.when(~F.col("del") & ~held, 1).when(F.col("del") & held, -1).otherwise(0)
    above = since.join(F.broadcast(top), F.col("seq") > F.col("last_seq")).select("k", "seq", change.alias("change")).where("change != 0")
    depth = F.sum("change").over(Window.partitionBy("k").orderBy("seq"))
    evicted = above.withColumn("depth", depth).groupBy("k").agg(F.max("depth").alias("most")).where(F.col("most") >= capacity)
    kept = top.join(evicted, "k", "left_anti")
    return kept.select("k", "last_seq", F.row_number().over(Window.orderBy(F.desc("last_seq"))).alias("place"))


def lru_segmented(log: DataFrame, capacity: int) -> DataFrame:
    """The most recent keys of each of four segments by key hash; here a DEL is an access like any other."""
    last = log.groupBy("k").agg(F.max("seq").alias("last_seq")).withColumn("segment", cache_segment("k"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("last_seq")))
    return last.withColumn("place", place).where(F.col("place") <= capacity).select("segment", "k", "last_seq", "place")
