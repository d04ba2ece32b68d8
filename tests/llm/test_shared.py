import os
import pytest

from tidelog.llm import neardup, queries, shared


def folders(spark):
    base = f"{shared.shared_dir(spark)}/tidelog"
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_what_is_settled_is_released(spark):
    before = folders(spark)
    with shared.settling(spark):
        df = shared.settle(spark.range(3), "kept")
        gone = shared.settle(spark.range(3), "gone")
        shared.drop(gone)
        shared.drop(gone)
        assert df.count() == 3 and len(folders(spark) - before) == 1
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), shared.settling(spark, always=False):
        shared.settle(spark.range(3), "failed")
        raise ZeroDivisionError
    assert folders(spark) == before


def test_a_query_that_fails_leaves_nothing(spark, monkeypatch):
    before = folders(spark)

    def fails(docs, **_):
        shared.settle(docs, "part")
        raise ZeroDivisionError

    monkeypatch.setattr(queries.substrings, "removed", fails)
    with pytest.raises(ZeroDivisionError):
        queries.QUERIES["op5_substring_dedup"](spark, "/root/testdata/sf0.001")
    assert folders(spark) == before


def test_few_files_for_many_small_partitions(spark, monkeypatch):
    """At most two files a core for little data; one for each FILE_BYTES of the tables read for more; the same rows."""
    most, parts = 2 * spark.sparkContext.defaultParallelism, lambda df: len(set(df.inputFiles()))
    with shared.settling(spark):
        many = shared.settle(spark.range(0, 3000, 1, 60), "many")
        few = shared.settle(spark.range(0, 3000, 1, 60), "few", few=True)
        assert parts(many) == 60 and parts(few) <= most and sorted(few.collect()) == sorted(many.collect())
        assert parts(shared.settle(many.repartition(60, "id"), "more", few=True)) <= most
        monkeypatch.setattr(shared, "FILE_BYTES", 100)
        assert parts(shared.settle(many.repartition(60, "id"), "all", few=True)) > most


def test_near_dedup_settles_no_file_a_partition(spark, monkeypatch, tmp_path):
    """Tables of a few rows over many partitions, as on tables dealt over hundreds of them."""
    rows = [(i, f"{'same words here in all of them ' * 4} and {i % 7} of {i % 5}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen, real = shared.read(spark, tmp_path, "documents"), {}, shared._delete
    for k, v in (("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.files.openCostInBytes", "0")):
        old = spark.conf.get(k)
        spark.conf.set(k, v)
        seen[k] = old
    counts = []

    def delete(session, paths):
        counts.extend(len(set(session.read.parquet(p).inputFiles())) for p in paths)
        real(session, paths)

    monkeypatch.setattr(shared, "_delete", delete)
    try:
        with shared.settling(spark):
            assert neardup.groups(docs, size=3, percent=85).count() == 400
    finally:
        for k, v in seen.items():
            spark.conf.set(k, v)
    assert len(counts) > 5 and max(counts) <= 2 * spark.sparkContext.defaultParallelism
