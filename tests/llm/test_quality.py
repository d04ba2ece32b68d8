import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import quality

SF = "/root/testdata/sf0.01"


def test_density_matches_the_formula():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (60, 3)), rng.normal(2, 2, (90, 3))]
    y = np.r_[np.zeros(60, int), np.ones(90, int)]
    m = quality.fit(x, y)
    want = []
    for k in (0, 1):
        cov = np.linalg.inv(m.whiten[k].T @ m.whiten[k])
        d = x / m.scale - m.mean[k]
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov))))
    assert np.allclose(m.margin(x), want[1] - want[0])
    assert ((m.score(x) >= 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95


def plain(text):
    """The statistics of a text, character by character and word by word."""
    text = text or ""
    words = [w for w in re.split("[\\x20\\x09-\\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    count = lambda test: sum(map(test, text))
    lower, upper, digit = count(lambda c: "a" <= c <= "z"), count(lambda c: "A" <= c <= "Z"), count(lambda c: "0" <= c <= "9")
    line, stop, wide, blank = text.count("\n"), text.count(".") + text.count(","), count(lambda c: ord(c) > 127), count(lambda c: c in " \t\x0b\x0c\r")
    other = len(text) - lower - upper - digit - line - stop - wide - blank
    c, w, seen = max(len(text), 1), max(len(words), 1), Counter(words)
    again = [sum(a == b for a, b in zip(words, words[k:], strict=False)) for k in (1, 2)]
    root = math.sqrt
    return [
        math.log1p(len(text)), math.log1p((lower + upper + wide) / w), root(other / c), root(other / w), root(stop / w), root(digit / c), root(upper / c), root(line / w), root(again[0] / w), root(again[1] / w),
        root(max(seen.values(), default=0) / w), math.log1p(len(seen)) / math.log1p(w), root(wide / c),
    ]


def brute(train, rows):
    """Scores of rows by the formula, from (text, label) pairs."""
    x, y = np.array([plain(t) for t, _ in train]), np.array([v for _, v in train])
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    scale = np.sqrt(sum(((x[y == k] - means[k]) ** 2).sum(axis=0) for k in (0, 1)) / len(x)) + 1e-3
    own = [np.cov(x[y == k].T / scale[:, None], bias=True) for k in (0, 1)]
    pooled = sum(own[k] * (y == k).sum() for k in (0, 1)) / len(x)
    cov = [(1 - quality.SHRINK - quality.SHRINK_DIAGONAL) * o + quality.SHRINK * pooled + quality.SHRINK_DIAGONAL * np.diag(np.diag(pooled) + 1e-3) for o in own]

    def margin(v):
        d = [(v - m) / scale for m in means]
        density = [-0.5 * (a @ np.linalg.inv(s) @ a + np.linalg.slogdet(s)[1]) for a, s in zip(d, cov, strict=True)]
        return density[1] - density[0]

    own_margins = sorted(zip(map(margin, x), y, strict=True))
    m = [own_margins[0][0], *(v for v, _ in own_margins), own_margins[-1][0]]
    wrong = [sum(v == 1 for _, v in own_margins[:k]) + sum(v == 0 for _, v in own_margins[k:]) for k in range(len(x) + 1)]
    best = [k for k, n in enumerate(wrong) if n == min(wrong)]
    k = best[len(best) // 2]
    cut = (m[k] + m[k + 1]) / 2
    return [1 / (1 + math.exp(-max(-50, min(50, (margin(np.array(plain(t))) - cut) / quality.SOFTEN)))) for t in rows]


def test_scores_match_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [(texts[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts]
    rows = quality.scores(docs, quality.train(docs, labels)).collect()
    want = brute(train, [texts[r.doc_id] for r in rows])
    for r, score in zip(rows, want, strict=True):
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_stage_on_empty_repeated_and_long_rows(spark, frame):
    docs = frame([(1, "A clean line of words."), (1, "A clean line of words."), (2, None), (None, "words " * 200_000)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    want = [r.score >= 0.5 for r in quality.scores(docs, model).collect()]
    assert quality.accept(docs, model).count() == sum(want) and quality.accept(docs.limit(0), model).count() == 0


def test_odd_rows(spark, frame):
    docs = frame([(1, "A clean line of words."), (2, None), (3, ""), (None, "x"), (4, "%%% ### " * 90000), (4, "%%% ### ")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (4, 0), (9, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.scores(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    kept = quality.accept(docs, model)
    assert kept.columns == docs.columns
    assert quality.scores(docs, quality.train(docs, labels.limit(0))).first().score == 0.5
    assert quality.scores(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("text,column", [("aa aa aa b", 8), ("Az 1.", 6)])
def test_statistics(text, column):
    x = quality.statistics(pa.array([text, None, ""]))
    assert x[0, column] > 0 and (x[1] == x[2]).all()
