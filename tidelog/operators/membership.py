"""Bloom filters of runs as relations of set bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import bloom_positions, poly31
from tidelog.operators.runs import bloom_parameters, collapse

SEGMENTS = 4


def bits(log: DataFrame) -> DataFrame:
    """run and each set bit."""
    sized = collapse(log).select("run", "k").join(bloom_parameters(log), "run")
    return sized.select("run", F.explode(bloom_positions("k", "b_bits", "b_hashes")).alias("position")).distinct()


def segmented_bits(log: DataFrame) -> DataFrame:
    """The same with four sub-filters, each sized for a quarter of the keys."""
    sized = collapse(log).select("run", "k").join(bloom_parameters(log, segments=SEGMENTS), "run")
    return sized.select("run", poly31(F.col("k"), SEGMENTS).alias("segment"), F.explode(bloom_positions("k", "b_bits", "b_hashes")).alias("position")).distinct()


def probe(log: DataFrame, probes: DataFrame) -> DataFrame:
    """run, k and whether the run's filter may hold the probe key: all of the key's bits must be set."""
    sizes = bloom_parameters(log).select("run", "b_bits", "b_hashes")
    asked = probes.select("k").distinct().join(sizes, F.lit(True))
    wanted = asked.select("run", "k", F.explode(F.array_distinct(bloom_positions("k", "b_bits", "b_hashes"))).alias("position"))
    hit = wanted.join(bits(log).withColumn("set", F.lit(1)), ["run", "position"], "left")
    return hit.groupBy("run", "k").agg((F.count("*") == F.count("set")).alias("might_contain"))


def portable_bits(log: DataFrame) -> DataFrame:
    """run and each bit set at 10 bits a key and 7 seeded hashes, in the JVM: the first 60 bits of the MD5 of seed and key."""
    sized = collapse(log).select("run", "k").join(bloom_parameters(log), "run")
    places = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), "k").cast("binary")), 1, 15), 16, 10).cast("long") % F.col("a_bits"))
    return sized.select("run", F.explode(places).alias("position")).distinct()
