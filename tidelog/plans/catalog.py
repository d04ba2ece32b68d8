"""The named queries over the test tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import lines, resp
from tidelog.operators import compaction, flow, membership, recency, runs, state
from tidelog.sources import folder, runfiles
from tidelog.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLUSH_BYTES = 4096
NEWEST_LEVEL0 = 45
LRU_KEYS, LRU_SEGMENT_KEYS = 64, 1000
BUCKET_RATE, BUCKET_CAPACITY = 1, 3
#: Lines for the tokenisers, as (pos, line).
LINES = ["SET k some value", "set key  spaced   value ", "SET E x", "GET k", "get", "DEL a b", "del", "SYNC now", "debug", "EXIT", "quit", "  ", "PUT k v", "SET k", "\tSET a\tb c", "GET  user:1"]
QUOTED = ['SET k "a b"', 'GET "k"', 'SET k ""', '  DEL   k  ', 'a"b c"d e', '""', "plain", 'x "" y', 'SET "two words" "and three more"']
#: Commands for the dispatcher, as argument lists; None is a null argument.
COMMANDS = [["SET", "a", "1"], ["set", "a"], ["SET", None, "1"], ["SET", "a", "1", "extra"], ["GET", "user:1"], ["get", "user:none"], ["GET"], ["GET", None], ["DEL", "a"], ["DEL", "a", "b"], ["del"], ["DEL", None], ["PING"], ["flush", "x"], [], [None, "a"]]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _early(log: DataFrame) -> DataFrame:
    return log.where("run < 5")


@query
def kv_latest(spark, sf):
    return state.latest(model.events_log(spark, sf))


@query
def kv_latest_window(spark, sf):
    return state.latest_by_rank(model.events_log(spark, sf))


@query
def kv_latest_empty_tombstone(spark, sf):
    log = model.events_log(spark, sf).withColumn("v", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("v")))
    return state.latest(model.empty_deletes(log))


@query
def kv_get(spark, sf):
    return state.get(model.events_log(spark, sf), "user:1")


@query
def kv_get_missing(spark, sf):
    return state.get(model.events_log(spark, sf), "user:none")


@query
def kv_multi_get(spark, sf):
    return state.multi_get(model.events_log(spark, sf), model.requests(spark, sf))


@query
def kv_semi_present(spark, sf):
    return state.present(model.events_log(spark, sf), model.requests(spark, sf))


@query
def kv_anti_deleted(spark, sf):
    return state.absent(model.events_log(spark, sf), model.requests(spark, sf))


@query
def kv_multi_set(spark, sf):
    return state.multi_set(model.events_log(spark, sf), model.batch(spark, sf))


@query
def kv_deleted_keys(spark, sf):
    return state.deleted(model.events_log(spark, sf))


@query
def kv_memory_usage(spark, sf):
    return state.memory_usage(model.events_log(spark, sf))


@query
def kv_op_counts(spark, sf):
    return state.op_counts(model.events_log(spark, sf))


@query
def kv_memtable_collapse(spark, sf):
    return runs.collapse(model.events_log(spark, sf))


@query
def kv_flush_boundaries(spark, sf):
    return runs.flush_boundaries(model.events_log(spark, sf), FLUSH_BYTES)


@query
def kv_flush_runs(spark, sf):
    """Writes every run as sorted Parquet and reads them again."""
    path = folder.scratch(spark, "runs")
    runfiles.write(model.events_log(spark, sf), path, "run")
    return runfiles.read(spark, path).select(F.col("run").cast("long").alias("run"), "k", "v", "seq", "del")


@query
def kv_flush_shards(spark, sf):
    """The same with a run for each shard."""
    path = folder.scratch(spark, "shards")
    runfiles.write(runs.sharded(model.events_log(spark, sf)).drop("run"), path, "shard")
    return runfiles.read(spark, path).select(F.col("shard").cast("int").alias("shard"), "k", "v", "seq", "del")


@query
def kv_run_stats(spark, sf):
    return runs.stats(model.events_log(spark, sf))


@query
def kv_tree_stats(spark, sf):
    return runs.tree(model.events_log(spark, sf), NEWEST_LEVEL0)


@query
def kv_wal_replay(spark, sf):
    """Writes the log, reads it again and replays it; tombstones are state too."""
    path = folder.scratch(spark, "log")
    model.events_log(spark, sf).select("k", "v", "seq", "del").write.parquet(path)
    return state.newest(runfiles.read(spark, path)).select("k", "v", "seq", "del")


@query
def kv_wal_tail(spark, sf):
    """Mutations newer than the last flushed run (all but the newest run are flushed)."""
    log = model.events_log(spark, sf)
    return log.join(F.broadcast(log.agg(F.max("run").alias("run"))), "run", "left_semi").select("k", "v", "seq", "del")


@query
def kv_seed(spark, sf):
    return state.seeded(model.events_log(spark, sf))


@query
def kv_layered_read(spark, sf):
    return state.layered(model.events_log(spark, sf))


@query
def kv_version_history(spark, sf):
    return state.history(model.events_log(spark, sf))


@query
def kv_sorted_scan(spark, sf):
    return state.sorted_scan(model.events_log(spark, sf), 100)


@query
def kv_range_prune(spark, sf):
    probes = model.table(spark, sf, "customer").select(F.concat(F.lit("order:"), F.lpad((F.col("c_custkey") * 7).cast("string"), 8, "0")).alias("k"))
    return compaction.candidates(model.orders_log(spark, sf), probes)


@query
def kv_compaction_overlap(spark, sf):
    return compaction.overlaps(model.orders_log(spark, sf, 500), model.orders_log(spark, sf))


@query
def kv_level_remaining(spark, sf):
    return compaction.remaining(model.orders_log(spark, sf, 500).where("run < 4"), model.orders_log(spark, sf))


@query
def kv_keys_in_all_runs(spark, sf):
    return compaction.keys_in_all(_early(model.events_log(spark, sf)))


@query
def kv_fence_pointers(spark, sf):
    return runs.fences(model.events_log(spark, sf))


@query
def kv_fence_lookup(spark, sf):
    return runs.fence_lookup(model.events_log(spark, sf), model.requests(spark, sf))


@query
def kv_compact_a(spark, sf):
    return compaction.merge_dropping_all(_early(model.events_log(spark, sf)))


@query
def kv_compact_l0_b(spark, sf):
    return compaction.merge_dropping_covered(_early(model.events_log(spark, sf)))


@query
def kv_compact_deep_b(spark, sf):
    return compaction.merge_oldest(model.events_log(spark, sf))


@query
def kv_compact_safe(spark, sf):
    return compaction.merge_safely(model.events_log(spark, sf), F.col("run") >= 5)


@query
def kv_compact_resurrected(spark, sf):
    return compaction.resurrected(model.events_log(spark, sf), F.col("run").between(5, 9), F.col("run") < 5)


@query
def kv_compaction_due(spark, sf):
    return compaction.due(model.events_log(spark, sf), NEWEST_LEVEL0)


@query
def kv_shard_stats(spark, sf):
    return runs.shard_stats(model.events_log(spark, sf))


@query
def kv_cache_segment(spark, sf):
    from tidelog.functions.hashing import cache_segment

    return model.events_log(spark, sf).select("k").distinct().select("k", cache_segment("k").alias("segment"))


@query
def kv_bloom_params(spark, sf):
    return runs.bloom_parameters(model.events_log(spark, sf))


@query
def kv_bloom_bits(spark, sf):
    return membership.bits(model.events_log(spark, sf))


@query
def kv_bloom_segmented(spark, sf):
    return membership.segmented_bits(model.events_log(spark, sf))


@query
def kv_bloom_probe(spark, sf):
    return membership.probe(model.events_log(spark, sf), model.requests(spark, sf))


@query
def kv_bloom_a(spark, sf):
    return membership.portable_bits(model.events_log(spark, sf))


@query
def kv_common_prefix(spark, sf):
    return runs.common_prefix(model.orders_log(spark, sf))


@query
def kv_lru_state(spark, sf):
    return recency.lru(model.events_log(spark, sf), LRU_KEYS)


@query
def kv_lru_segmented(spark, sf):
    return recency.lru_segmented(model.events_log(spark, sf), LRU_SEGMENT_KEYS)


@query
def kv_token_bucket(spark, sf):
    events = model.table(spark, sf, "events").select(F.col("user_id").alias("who"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return flow.token_bucket(events, BUCKET_RATE, BUCKET_CAPACITY)


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    return model.table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("run"), F.col("event_type").isin("view", "click").alias("read"))


@query
def kv_adaptive_freq(spark, sf):
    return flow.adaptive_frequency(_operations(spark, sf))


@query
def kv_adaptive_freq_running(spark, sf):
    return flow.adaptive_frequency_running(_operations(spark, sf))


def _set_commands(spark: SparkSession, sf: str) -> DataFrame:
    docs = model.table(spark, sf, "documents")
    args = F.array(F.lit("SET"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", resp.command(args).alias("wire"))


@query
def resp_encode(spark, sf):
    return _set_commands(spark, sf)


@query
def resp_decode(spark, sf):
    name, key, value = resp.flat_arguments(F.col("wire"), 3)
    return _set_commands(spark, sf).select("doc_id", name.alias("command"), key.alias("k"), value.alias("v"))


@query
def resp_dispatch(spark, sf):
    asked = spark.createDataFrame(list(enumerate(COMMANDS)), "pos long, args array<string>")
    asked = asked.withColumn("k", F.get("args", F.lit(1)))
    live_ = state.latest(model.events_log(spark, sf)).select("k", F.col("v").alias("stored"))
    return asked.join(live_, "k", "left").select("pos", resp.dispatch(F.col("args"), F.col("stored")).alias("reply"))


@query
def resp_pipeline(spark, sf):
    """Three commands in each customer's buffer come back as three rows."""
    resp.register(spark)
    key = F.concat(F.lit("user:"), F.col("c_custkey").cast("string"))
    parts = [F.array(F.lit("SET"), key, F.col("c_name")), F.array(F.lit("get"), key), F.array(F.lit("DEL"), key)]
    buffers = model.table(spark, sf, "customer").select(F.col("c_custkey").alias("conn"), F.concat(*map(resp.command, parts)).alias("buffer"))
    buffers.createOrReplaceTempView("resp_buffers")
    rows = spark.sql("SELECT conn, v.pos, v.args, v.status FROM resp_buffers, LATERAL resp_values(buffer) AS v")
    return rows.select("conn", "pos", F.get("args", F.lit(0)).alias("command"), F.get("args", F.lit(1)).alias("k"), F.get("args", F.lit(2)).alias("v"), "status")


@query
def repl_parse(spark, sf):
    rows = spark.createDataFrame(list(enumerate(LINES)), "pos long, line string")
    return rows.select("pos", lines.repl(F.col("line")).alias("x")).select("pos", "x.command", "x.key", "x.value", "x.error")


@query
def client_tokenize(spark, sf):
    rows = spark.createDataFrame(list(enumerate(QUOTED)), "pos long, line string")
    return rows.select("pos", F.array_join(lines.quoted_tokens(F.col("line")), "|").alias("tokens"))


@query
def client_format(spark, sf):
    """What the client shows for the value of every fiftieth key, and for replies of each kind."""
    resp.register(spark)
    bulks = state.latest(model.events_log(spark, sf)).select(F.concat(F.lit("get "), "k").alias("of"), resp.bulk(F.col("v")).alias("wire"))
    other = spark.createDataFrame([("ok", "+OK\r\n"), ("error", "-bad\r\n"), ("one", ":1\r\n"), ("none", "$-1\r\n"), ("no array", "*-1\r\n"), ("array", "*2\r\n:7\r\n$1\r\na\r\n")], "of string, wire string")
    bulks.unionAll(other).createOrReplaceTempView("resp_replies")
    return spark.sql("SELECT of, v.shown FROM resp_replies, LATERAL resp_values(wire) AS v")


@query
def stream_kv_latest(spark, sf):
    return live.latest_events(spark, sf)


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.table(spark, sf, "lineitem")
    return rows.select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("user:"), (F.col("l_partkey") % 3000).cast("string")).alias("k"))


@query
def batch_get(spark, sf):
    """One lookup for each row of lineitem."""
    return state.multi_get(model.events_log(spark, sf), _keyed(spark, sf))


@query
def batch_set(spark, sf):
    """One upsert for each row of lineitem."""
    rows = _keyed(spark, sf).select("k", F.col("pos").cast("string").alias("v"), (F.col("pos") + 1_000_000_000).alias("seq"), F.lit(False).alias("del"))
    return state.multi_set(model.events_log(spark, sf), rows)


@query
def kv_operation_log(spark, sf):
    return state.operations(model.events_log(spark, sf))


@query
def kv_empty_shards(spark, sf):
    """Of the memtable of the newest run."""
    log = model.events_log(spark, sf)
    return runs.empty_shards(log.join(F.broadcast(log.agg(F.max("run").alias("run"))), "run", "left_semi"))


@query
def kv_flushes(spark, sf):
    return runs.flushes(model.events_log(spark, sf), FLUSH_BYTES)


@query
def kv_compact_expired(spark, sf):
    events = model.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return compaction.expired(model.events_log(spark, sf).join(events, "seq"))


@query
def kv_range_scan(spark, sf):
    return state.range_scan(model.events_log(spark, sf), "user:2", "user:4")
