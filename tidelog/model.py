"""The mutation log: one row a SET or DEL, and the views of it that the queries run on.

A log has the columns k (key), v (value), seq (unique, rising version), del
(whether the row is a tombstone) and run (the flushed run that holds it).
State is a query over a log, never something stored in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("k", "v", "seq", "del", "run")
SCHEMA = "k string, v string, seq long, del boolean, run long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping runs of 200 mutations; an ``error`` event deletes its user's key."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("k"),
        F.col("props").alias("v"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("del"),
        F.floor(F.col("event_id") / 200).alias("run"),
    )


def orders_log(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Disjoint runs of 1000 keys; ``shift`` moves the cuts."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("k"),
        F.col("o_orderstatus").alias("v"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("del"),
        F.floor((F.col("o_orderkey") + shift) / 1000).alias("run"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys with duplicates and misses, in the order of pos."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("user:"), (F.col("c_custkey") % 300).cast("string")).alias("k"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of SETs that is newer than the log."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user:"), (F.col("c_custkey") % 300).cast("string")).alias("k"), F.col("c_name").alias("v"), (F.lit(1_000_000_000).cast("long") + F.col("c_custkey")).alias("seq"), F.lit(False).alias("del"), F.lit(None).cast("long").alias("run")
    )


def empty_deletes(log: DataFrame) -> DataFrame:
    """The dialect in which setting an empty value deletes the key."""
    return log.withColumn("del", F.col("del") | (F.col("v") == ""))
