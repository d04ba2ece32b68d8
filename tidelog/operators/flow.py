"""Admission and pacing: sequential folds, each over one group's ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Frequencies in tenths, and windows that are composed together.
LEAST, MOST, GROUP = 5, 20, 4096


def token_bucket(requests: DataFrame, rate: int, capacity: int) -> DataFrame:
    """who, seq and whether each request (who, seq, at in microseconds) gets a token.

    A bucket starts full and is refilled by whole seconds. Rows stream past in order of (who, at, seq), so a bucket of any length needs the memory of one.
    """

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, last = None, 0, 0
        for batch in batches:
            out = []
            for who, at in zip(batch.column("who").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if who != now:
                    now, tokens, last = who, capacity, at
                passed = (at - last) // 1_000_000
                if passed > 0:
                    tokens, last = min(capacity, tokens + passed * rate), at
                out.append(tokens > 0)
                tokens -= tokens > 0
            yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("seq"), pa.array(out, pa.bool_())], names=["who", "seq", "admitted"])

    rows = requests.select(F.col("who").cast("long").alias("who"), "seq", "at").repartition("who").sortWithinPartitions("who", "at", "seq")
    return rows.mapInArrow(admit, "who long, seq long, admitted boolean")


def _ratio() -> F.Column:
    return F.floor(F.col("n_reads") / F.greatest("n_writes", F.lit(1)))


def _counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("run").agg(F.count(F.when(F.col("read"), 1)).alias("n_reads"), F.count(F.when(~F.col("read"), 1)).alias("n_writes")).withColumn("ratio", _ratio())


def adaptive_frequency(ops: DataFrame) -> DataFrame:
    """The frequency (in tenths) after one window of reads and writes, starting from 1.0."""
    step = F.when(F.col("ratio") > 10, 9).when(F.col("ratio") < 1, 11).otherwise(10)
    return _counts(ops).select("run", "n_reads", "n_writes", "ratio", step.alias("tenths"))


def adaptive_frequency_running(ops: DataFrame) -> DataFrame:
    """The frequency (in tenths, 5 to 20) after each window in turn.

    A window maps each of the 16 frequencies to the next one, and such maps compose: each group of windows is composed on
    its own, the groups' maps (a row for ``GROUP`` windows) are followed in order, and each group is gone through again from its start.
    """
    counts = _counts(ops).select("run", "ratio", F.floor(F.col("run") / GROUP).alias("group"))

    def follow(ratios, tenths):
        for ratio in ratios:
            yield (tenths := np.maximum(LEAST, tenths - 1) if ratio > 10 else np.minimum(MOST, tenths + 1) if ratio < 1 else tenths)

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        *_, last = follow(rows.sort_values("run")["ratio"], np.arange(LEAST, MOST + 1))
        return pd.DataFrame({"group": rows["group"][:1], "map": [last.tolist()]})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tenths, out = rows.sort_values("group"), 10, []
        for own in rows["map"]:
            out.append(tenths)
            tenths = int(own[tenths - LEAST])
        return rows.assign(start=out)[["group", "start"]]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        return rows.assign(tenths=[int(x) for x in follow(rows["ratio"], int(rows["start"].iloc[0]))])[["run", "ratio", "tenths"]]

    maps = counts.groupBy("group").applyInPandas(compose, "group long, map array<int>")
    starts = maps.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(chain, "group long, start int")
    return counts.join(starts, "group").groupBy("group").applyInPandas(walk, "run long, ratio long, tenths int")
