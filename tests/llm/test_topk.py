import math

import duckdb
import numpy as np
import pytest

from tidelog.llm import topk
from tidelog.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.01"


def brute(rows, k=10):
    ok = [(i, list(v), [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: w for i, _, w in sorted(ok, reverse=True)}.items()):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, _, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def search(df, **more):
    return sorted(map(tuple, topk.search(df, df.where("vec_id % 100 = 0"), **more).collect()))


def test_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert search(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


SMALL = {"block_rows": 4, "least_shard_rows": 20}


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(1, 90)]
    rows += [(100, [1.0] * 8), (100, [1.0] * 8), (200, [0.5] * 3), (300, None), (400, [1.0, None]), (500, [1.0, float("nan")]), (600, [float("inf")]), (None, [1.0] * 8), (700, []), (800, [-0.0005] * 8)]
    rows += [(1000 + i, [2.0] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' AS shard", "1 AS x")
    assert search(df, **SMALL) == search(df) == brute(rows)
    assert search(df.limit(0)) == []
    few = rows[-3:] + [(0, [1.0, 1e9])]
    assert search(spark.createDataFrame(few, "vec_id long, embedding array<double>")) == brute(few)


@pytest.mark.parametrize("size", [70_000.0, 3e6, 1e9, 2e12])
def test_large_components_score_exactly(spark, size):
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 70_000.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0]), (100, [1.0, 0.5, -0.25]), (101, [size, 3.0])]
    rows += [(200 + i, [float(x) for x in rng.normal(0, 1, 3) * (size if i % 7 == 0 and size < 3e6 else 1)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert search(df, **SMALL) == brute(rows)


def test_what_does_not_fit_a_long_is_an_error(spark):
    for rows in ([(0, [1e17]), (1, [1.0])], [(0, [1e12]), (1, [1e12])]):
        with pytest.raises(Exception, match="does not fit a long"):
            search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_repeated_query_ids_as_in_sql(spark, tmp_path):
    rows = [(100, [1.0, 5.0]), (100, [1.0002, 3.0]), (100, [1.0, 5.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = con.execute(ORACLE_SQL["op3_exact_top_k"])
    names = [d[0] for d in got.description]
    assert sorted(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in got.fetchall()) == search(df) == brute(rows)


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (20, 16))
    x = np.floor(1024 * (centre[rng.integers(0, 20, 4000)] + rng.normal(0, 0.05, (4000, 16)))).astype(np.int64)
    shard = topk.Shard(np.arange(4000), x)
    got = list(shard.search(np.array([-1]), x[:1], 10))
    assert [s for _, _, s in got] == sorted((x @ x[0]).tolist(), reverse=True)[:10]
    assert shard.scored < 2000
