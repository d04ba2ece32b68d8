"""Runs as Parquet: sorted by key, with Bloom filters on it, never changed once written.

Many runs share files, each a stretch of rows sorted by run and key, so small
runs cost no folder each; row-group statistics find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.state import newest

#: A filter starts at this many keys and shrinks to what its row group holds.
FILTER_KEYS = 1_000_000


def write(rows: DataFrame, path: str, *by: str, files: int | None = None) -> None:
    """Writes a run, or one for each value of ``by``: newest row of each key, tombstones kept, dealt by range and sorted."""
    run = newest(rows, *by, "k")
    run = run.repartitionByRange(files, *by, "k") if files else run.repartitionByRange(*by, "k")
    out = run.sortWithinPartitions(*by, "k").write.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(FILTER_KEYS))
    out.option("parquet.bloom.filter.adaptive.enabled#k", "true").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def summary(rows: DataFrame) -> DataFrame:
    """What the manifest says of a run."""
    return rows.agg(
        F.count("*").alias("n_keys"), F.count(F.when(F.col("del"), 1)).alias("n_tombstones"), F.min("k").alias("min_key"), F.max("k").alias("max_key"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.coalesce(F.sum(F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"),
    )
