import pyarrow as pa

import corpus_pipeline
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_decontamination import words
from tests.llm.test_neardup import brute
from tidelog.llm import quality, secrets, shared

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    mark = shared.settled()
    got = sorted(((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()), key=str)
    assert shared.settled() == mark + 1
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [(d, t) for d, t in docs if model.score(quality.statistics(pa.array([t])))[0] >= 0.5]
    kept = {d for d, _, _, k in brute(good, 5, 80) if k}
    assert {d for d, _ in got} <= kept < {d for d, _ in docs}
    assert got == rest(spark, SF, good, kept)
    assert 0 < len(got) < len(docs)


def rest(spark, sf, docs, kept):
    """(doc_id, ids) of kept documents after the stages that follow."""
    docs, windows = [(d, t) for d, t in docs if d in kept], set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    field = secrets.default_field()
    docs = [(d, secrets._without(t or "", secrets.all_spans(t or "", field))) for d, t in docs if clean(words(t))]
    return sorted(((d, LIBRARY.encode(t, add_special_tokens=False).ids) for d, t in docs), key=str)


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def tables(spark, path, docs, schema="doc_id long, text string, lang string, source string, n_chars long, rid long, flag string, n int, bucket string, _part int"):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(22, 1, 0), (20, 0, 0), (20, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def row(doc_id, text):
    return (doc_id, text, "en", "web", len(text or ""), 7, "flag", 3, "b", 1)


def test_empty_table(spark, tmp_path):
    sf = tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    texts = [(1, "A line of words that is good."), (1, "A line of words that is good."), (20, "%%% ### " * 40), (22, "Another fair line, with more words than that."), (3, None), (4, ""), (None, "Some other line of plain words."), (None, None), (5, long), (6, long), (7, "x one two three four five six seven eight nine ten eleven y"), (8, "my pwd: hunter2x9 and more words")]
    sf = tables(spark, tmp_path, [row(*x) for x in texts])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.settle(stage(spark, docs, sf), "stage")
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns and docs.where("flag != 'flag' OR rid != 7 OR n != 3 OR bucket != 'b' OR _part != 1").isEmpty()
    got = corpus_pipeline.run(spark, sf).collect()
    left = [r.doc_id for r in got]
    assert left.count(1) <= 1 and (5 in left) + (6 in left) <= 1 and 7 not in left and 20 not in left and 22 in left
    assert sorted(left, key=str) == sorted((r.doc_id for r in docs.collect()), key=str)
    assert not any("hunter2x9" in (r.text or "") for r in docs.collect())
