"""Every catalogue query with SQL against DuckDB over the same files."""

import random
from collections import OrderedDict

import duckdb
import pytest

from tidelog import model
from tidelog.operators import compaction, recency
from tidelog.plans.catalog import FLUSH_BYTES, QUERIES
from tidelog.plans.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


def test_queries_without_sql_are_tested_elsewhere():
    assert set(QUERIES) - set(ORACLE_SQL) == {"kv_flushes"}


def test_flushes_match_a_fold(spark):
    """Each shard's memtable, entry by entry."""
    rows = QUERIES["kv_flushes"](spark, SF).collect()
    log = {r.seq: r for r in model.events_log(spark, SF).collect()}
    assert sorted(r.seq for r in rows) == sorted(log)
    for s in {r.shard for r in rows}:
        held, flush = {}, 0
        for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.seq):
            size = len(r.k.encode()) + len(log[r.seq].v.encode()) + 16
            if held and sum(held.values()) + size > FLUSH_BYTES:
                held, flush = {}, flush + 1
            held[r.k] = size
            assert r.flush == flush


def test_lru_matches_a_cache(spark):
    rng = random.Random(9)
    for capacity in (1, 3, 7):
        rows = [(f"k{rng.randrange(14)}", i, rng.random() < 0.35) for i in range(120)]
        cache = OrderedDict()
        for k, seq, gone in rows:
            cache.pop(k, None)
            if not gone:
                cache[k] = seq
                if len(cache) > capacity:
                    cache.popitem(last=False)
        got = recency.lru(spark.createDataFrame(rows, "k string, seq long, del boolean"), capacity).collect()
        assert [(r.k, r.last_seq) for r in sorted(got, key=lambda r: r.place)] == list(reversed(cache.items()))
    assert recency.lru(spark.createDataFrame([], "k string, seq long, del boolean"), 3).count() == 0


def test_range_queries_match_loops(spark):
    rng = random.Random(1)
    rows = [(f"{rng.randrange(400):03d}", "v", i, False, i // 4) for i in range(240)]
    log = spark.createDataFrame(rows, "k string, v string, seq long, del boolean, run long")
    ranges = {}
    for k, _, _, _, run in rows:
        a, b = ranges.get(run, (k, k))
        ranges[run] = (min(a, k), max(b, k))
    probes = [f"{i:03d}" for i in range(0, 420, 3)]
    got = compaction.candidates(log, spark.createDataFrame([(p,) for p in probes * 2], "k string")).collect()
    assert sorted((r.k, r.n_runs) for r in got) == [(p, sum(a <= p <= b for a, b in ranges.values())) for p in probes]
    upper = log.where("run < 20")
    got = compaction.overlaps(upper, log).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(20) for b in sorted(ranges) if max(ranges[a][0], ranges[b][0]) <= min(ranges[a][1], ranges[b][1])]
    assert compaction.overlaps(upper.limit(0), log.limit(0)).count() == 0 and compaction.candidates(log.limit(0), log.select("k").limit(1)).first().n_runs == 0


def test_no_nested_loops_over_manifests(spark):
    for name in ("kv_range_prune", "kv_compaction_overlap", "kv_level_remaining"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
