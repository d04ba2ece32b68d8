import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidelog.llm import language as L

SF = "/root/testdata/sf0.01"


def plain(text):
    """The bundle, trigram by trigram."""
    letters, out = L._Letters.get(), np.zeros(L.DIMENSIONS)
    s = [0, *(int(letters.symbol[ord(c)]) for c in text or ""), 0]
    for (a, b, c), n in Counter((s[i - 1], s[i], s[i + 1]) for i in range(1, len(s) - 1) if s[i]).items():
        base = letters.vectors[2]
        out += n * np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return out, sum(x > 0 for x in s)


def test_profiles_match_the_definition():
    texts = ["Hello, wörld", None, "", "123 !!", "ÀÉ中文 x", "ab", "cd", "word " * 300, "😀a"]
    for repeat in (1, 300):
        x, n = L.profiles(pa.array(texts * repeat))
        for i, t in enumerate(texts):
            want, letters = plain(t)
            assert np.allclose(x[-len(texts) + i], want) and n[-len(texts) + i] == letters


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.predict(docs, L.train(docs)).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(got[r.doc_id].held_out for r in held)
    assert sum(g.held_out for g in got.values()) == len(held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97


def test_predictions_match_brute_force(spark):
    """Prototypes and cosines over whole texts, trigram by trigram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 20000")
    rows, sums = docs.collect(), {}
    bundles = {r.doc_id: plain(r.text) for r in rows}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            x = bundles[r.doc_id][0]
            sums[r.lang] = sums.get(r.lang, 0) + x / max(np.linalg.norm(x), 1e-9)
    names = sorted(sums)
    matrix = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    got = {r.doc_id: r for r in L.predict(docs, L.train(docs)).collect()}
    for r in rows:
        x, letters = bundles[r.doc_id]
        cosine = matrix @ x / max(np.linalg.norm(x), 1e-9)
        g = got[r.doc_id]
        assert abs(g.score - (max(cosine.max(), 0) if letters else 0)) < 1e-4
        assert g.lang_pred == (names[int(cosine.argmax())] if letters else "und") or np.ptp(np.sort(cosine)[-2:]) < 1e-5


def test_odd_rows(spark, frame):
    docs = frame([(1, "the cat", "en"), (2, None, "en"), (3, "12 -", None), (None, "le chat", "fr"), (4, "der hund", "de"), (4, "der hund", "de"), (5, "x " * 100000, None)], "doc_id long, text string, lang string")
    model = L.train(docs)
    assert "fr" not in model
    rows = L.predict(docs, model).collect()
    assert len(rows) == 7 and all((r.lang_pred == "und") == (r.doc_id in (2, 3)) for r in rows if r.doc_id)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0 and L.train(docs.limit(0)) == {}
    assert set(L.train(docs, fit_rows=1)) <= set(model)
