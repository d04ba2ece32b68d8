import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import substrings
from tidelog.llm.fmindex import FMIndex, WaveletMatrix

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=35):
    all_words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, all_words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(substrings.removed(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_rows_in_another_order_on_each_read(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert rows(substrings.removed(docs.repartition(9))) == want
    assert rows(substrings.removed(docs.withColumn("r", F.rand()).sort("r").drop("r"))) == want


def test_many_copies(spark, frame):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(900)}"
    text, other = (" ".join(word() for _ in range(80)) for _ in range(2))
    docs = [(i, text) for i in range(700)] + [(1000 + i, f"{text} {word()} {other if i % 2 else ''}") for i in range(40)] + [(2000, other)]
    assert rows(substrings.removed(frame(docs).repartition(8))) == brute(docs)


@pytest.mark.parametrize(("common", "heavy"), [(256, 1024), (3, 1024), (3, 2), (1000, 3)])
def test_common_passages_and_odd_rows(spark, frame, common, heavy):
    rng = random.Random(5)
    word = lambda: f"é{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "short text"), (5, "a " * 34), (6, "a " * 34), (7, "b " * 36), (8, "x\x00y " * 5000)]
    for i in range(30):
        docs.append((100 + i, " \n".join([*(word() for _ in range(rng.randrange(50))), *passage[: rng.randrange(30, 61)], *(word() for _ in range(50))])))
    docs += [docs[-1], (None, docs[-2][1])]
    df = substrings.removed(frame(docs), anchor_bits=1 << 15, common=common, heavy=heavy)
    assert rows(df) == brute(docs)
    for r in df.collect():
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert substrings.removed(frame(docs).limit(0)).count() == 0


def test_rank():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 11, 1000)
    w = WaveletMatrix(text, 4)
    for c in range(11):
        at = np.arange(0, 1001)
        start = w.rank(np.array([c]), np.array([0]))
        assert (w.rank(np.full(1001, c), at) - start == np.r_[0, np.cumsum(text == c)]).all()


def longest(text, at, seen):
    n = 0
    while at + n < len(text) and seen[text[at : at + n + 1]] > 1:
        n += 1
    return n


@pytest.mark.parametrize("size", [2, 5, 50])
def test_matching_statistics(size):
    rng = np.random.default_rng(size)
    base = rng.integers(1, size, 300)
    own = list({tuple(base[s : s + n].tolist()) for s, n in zip(rng.integers(0, 238, 120), rng.integers(1, 62, 120), strict=True)})
    weight = rng.integers(1, 3, len(own))
    seen = Counter()
    for s, w in zip(own, weight, strict=True):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                seen[s[i:j]] += w
    texts = [*own, tuple(base.tolist()), tuple(rng.integers(0, size + 2, 400).tolist()), (), (99,), (1,)]
    hashes = lambda xs: np.array([x for s in xs for x in s], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    index = FMIndex(hashes(own), np.array([len(s) for s in own]), weight)
    got = index.statistics(hashes(texts), np.array([len(s) for s in texts])).tolist()
    assert got == [longest(s, i, seen) for s in texts for i in range(len(s))]
    assert FMIndex(hashes([]), np.empty(0, np.int64), weight[:0]).statistics(hashes(own), np.array([len(s) for s in own])).sum() == 0
