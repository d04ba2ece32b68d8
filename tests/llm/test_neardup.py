import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import neardup
from tidelog.llm.components import components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, size, percent):
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {k for g in s for k in where[g] if k > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 85)
    assert rows(neardup.groups(docs, size=3, percent=85)) == want


def test_chains_and_odd_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = [(1, None), (2, ""), (2, ""), (3, "one"), (4, "One"), (5, "one two"), (6, " \t"), (None, "one two"), (None, "lonely words here now"), (7, "x y " * 20000)]
    words = list(base)
    for i in range(40):
        at = rng.randrange(120)
        words[at] = f"v{i}"
        docs.append((100 - i, " ".join(words)))
        docs.append((200 + i, " ".join([*base[:60], *(f"u{i}_{k}" for k in range(rng.randrange(5, 14)))])))
    docs.append((300, docs[-1][1].upper()))
    data = frame(docs)
    got = neardup.groups(data, size=3, percent=85)
    assert rows(got) == brute(docs, 3, 85)
    kept = neardup.dedup(data, size=3, percent=85)
    assert kept.columns == data.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([d for d, _, _, k in brute(docs, 3, 85) if k])
    assert neardup.groups(data.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_large_mixed_buckets(spark, monkeypatch, block):
    """Clusters whose members share a long part, so that buckets hold several components of many sizes."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(9000)}"
    common, docs = [word() for _ in range(100)], []
    for cluster, members in enumerate([60, 25, 9, 3, 1, 1, 1]):
        own = [word() for _ in range(30)]
        for i in range(members):
            line = [*common, *own]
            for _ in range(rng.randrange(3)):
                line[rng.randrange(100, 130)] = word()
            docs.append((1000 * cluster + i, " ".join(line)))
    rng.shuffle(docs)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    got = rows(neardup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), size=3, percent=85))
    assert got == brute(docs, 3, 85)
    assert 1 < len({c for _, _, c, _ in got}) < len(docs) // 2


def test_minima_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    x = neardup.minima([a, np.r_[a[:900], np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))], a[:0]])
    assert (x[0] == x[1]).mean() == pytest.approx(900 / 1100, abs=0.12) and not x[2].any()
    assert [len(s) for s in neardup.shingles(pa.array(["a b c d", "a", None]), 3)] == [2, 1, 0]
