import hashlib
import random
import re
import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm.decontamination import Shard, TestSuffixes, contamination, remove

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item_id, t in bench:
            b = words(t)
            if not b or item_id is None:
                continue
            k = min(n, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    items.add(item_id)
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ABC = "a b c d e f g h i j k l m n o p"
BENCH = [(1, ABC), (2, "Été là"), (10, ABC + " q r"), (10, ABC + " q r"), (3, None), (4, "..."), (None, "x y"), (5, "a a a a a a a a a a a a")]
DOCS = [(1, "zz " + ABC.upper() + "-Q r"), (2, None), (3, ""), (4, "x y Été,là été là"), (5, "a b c d e f g h i"), (None, "b c d e f g h i j k!"), (7, "a " * 40), (7, "a " * 40), (8, "w " * 30000 + ABC)]
COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("words", [2_000_000, 5])
def test_matches_brute_force(spark, frame, words):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = contamination(frame(DOCS), bench, pass_words=words).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in rows), key=str) == brute(DOCS, BENCH)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and len({m.item_id for m in r.matches}) == len(r.matches) == r.n_items


def longest(doc, items):
    """Of each item with a window in the document: length, place here and there of its longest match."""
    out = {}
    for item_id, b in items:
        k = min(10, len(b))
        found = []
        for h in range(len(doc)):
            for t in range(len(b)):
                n = 0
                while h + n < len(doc) and t + n < len(b) and doc[h + n] == b[t + n]:
                    n += 1
                if n >= k and k:
                    found.append((-n, h, t))
        if found:
            n, h, t = min(found)
            out[item_id] = (t, h, -n)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "ab\u00e9"])
def test_random_texts_match_brute_force(letters):
    rng = random.Random(letters)
    line = lambda n: [rng.choice(letters) for _ in range(n)]
    for _ in range(25):
        items = [(i, line(rng.choice([3, 9, 10, 14, 30]))) for i in range(4)]
        docs = []
        for _ in range(5):
            doc = line(rng.randrange(40)) + ["zz"] * rng.randrange(2)
            for _ in range(rng.randrange(3)):
                own = rng.choice(items)[1]
                at = rng.randrange(len(own))
                doc += own[at : at + rng.randrange(1, 25)] + line(rng.randrange(4))
            docs.append(doc)
        shard = Shard(pa.array([" ".join(d) for d in docs]), test := TestSuffixes([(i, " ".join(t)) for i, t in items], 10), 10)
        covered = shard.search()
        doc, item, here, there, size = (x.tolist() for x in shard.matches())
        got = [{} for _ in docs]
        for d, i, h, t, n in zip(doc, item, here, there, size, strict=True):
            got[d][i] = (t - int(test.line.base[test.item[t]]), h - int(shard.line.base[d]), n)
        for d, words_ in enumerate(docs):
            hit = set()
            for _, b in items:
                k = min(10, len(b))
                wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
                for i in range(len(words_) - k + 1):
                    if tuple(words_[i : i + k]) in wins:
                        hit |= set(range(i, i + k))
            base = int(shard.line.base[d])
            assert set(np.flatnonzero(covered[base : base + len(words_)]).tolist()) == hit
            assert got[d] == longest(words_, items)


def test_repeated_words_stay_cheap():
    test = TestSuffixes([(1, "a " * 5000)], 10)
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    shard = Shard(pa.array(["a " * 200_000]), test, 10)
    assert shard.search().sum() == 200_000 and [x.tolist() for x in shard.matches()][4] == [5000]
    assert time.process_time() - start < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_equal_hashes_of_unequal_words_are_no_match(monkeypatch):
    test = TestSuffixes([(1, "one two three"), (2, "two two two")], 3)
    shard = Shard(pa.array(["one two three x two two two", "one two three"]), test, 3)
    code = shard.line.codes.copy()
    shard.line.codes[shard.line.place[3]] = code[1]
    codes = shard.line.codes[shard.line.place]
    shard.index(codes)
    covered = shard.search()
    assert covered.tolist() == [True] * 3 + [False] + [True] * 3 + [False] + [True] * 3 + [False]


def test_places_and_longest_match(spark, frame):
    bench = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    row = contamination(frame([(1, "zz c d e f g h i j k l m zz")]), bench).first()
    assert row.longest_match == 11 and [tuple(m) for m in row.matches] == [(1, 2, 1, 11)]


def test_remove_keeps_clean_rows_whole(spark, frame):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = frame(DOCS)
    kept = remove(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 5]
    assert remove(docs, bench.limit(0)).count() == len(DOCS)
    assert contamination(docs.limit(0), bench).count() == 0
    assert sorted((r.doc_id for r in remove(docs, bench, pass_words=5).collect()), key=str) == [2, 3, 5]
