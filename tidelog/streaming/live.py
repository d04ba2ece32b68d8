"""Live state of an unbounded log, and a stream that feeds a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.operators.state import newest
from tidelog.sources import folder


def stream_log(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 100) -> DataFrame:
    """A streaming read of a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live(log: DataFrame) -> DataFrame:
    """Newest row of each key of a streaming log: order of arrival does not matter, so no watermark is needed."""
    return newest(log.select("k", "v", "seq", "del"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result, kept as Parquet in the shared folder."""
    spark = stream.sparkSession
    out, mark = folder.scratch(spark, name), folder.scratch(spark, f"{name}-offsets")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live state of the events log, computed by a stream."""
    static = model.table(spark, sf_dir, "events")
    events = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    log = events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("k"), F.col("props").alias("v"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("del"))
    return drain(live(log), "live").where("NOT del").select("k", "v", "seq")


def feed(log: DataFrame, store, checkpoint: str):
    """Appends the newest row of each key of each micro-batch (k, v, del, seq) to a store; returns the running query.

    A batch replayed after a failure sets what it had set, which leaves state as it was.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        store.append(newest(batch.select("k", "v", "seq", "del")).select(F.lit(0).alias("pos"), "k", "v", "del"))

    return log.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
