import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import bpe

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)
TEXTS = [
    None, "", "  \n\t ", "Hello WORLD it's 1234 naïve café é", "ΣΑΣ Σ aaa aaaa aaaaaaa abababab", "%%% &&&! <|endoftext|>x<|startoftext|> a<|endoftext|>b<|", "中文 😀😀 　x y \x00 \x1c z\x85q", "İstanbul ﬁ don't we'll 'S ' ''s", "word " * 30000, "x" * 20000,
]


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_digests_match_the_library(spark, frame):
    docs = frame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[3])])
    rows = bpe.digests(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids, text = want(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_encode_and_decode(spark, frame):
    docs = frame(list(enumerate(TEXTS)))
    ids = bpe.encode(docs)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: want(t)[0] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in bpe.decode(ids).collect()} == {i: want(t)[1] for i, t in enumerate(TEXTS)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthein's., ésTHE1"), max_size=30), max_size=6))
def test_words_match_the_library(texts):
    words = [w.encode() for t in texts for w in t.split()]
    (of,) = bpe.Encoder(VOCABULARY, lambda ids: "".join(f" {i}" for i in ids)).learn([words])
    assert [[int(i) for i in of(w).split()] for w in words] == [LIBRARY.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_forgotten_words_and_long_texts_match_the_library(spark, frame):
    """Several slices with more distinct words than are kept, then a slice of as many others; a text of several stretches."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(400_100)) for _ in range(2)]
    texts += ["word \u00a0 x\u3000 " * 600_000, "y" + " " * (9 << 20) + "z<|endoftext|>", "\u00a0 \u3000 " * 1_200_000 + "end"]
    docs = frame(list(enumerate(texts))).repartitionByRange(2, F.col("doc_id") < 2)
    ids = {r.doc_id: (r.n_tokens, r.ids) for r in bpe.encode(docs).collect()}
    for r in bpe.digests(docs).collect():
        own, text = want(texts[r.doc_id])
        assert (r.n_tokens, list(ids[r.doc_id][1])) == (len(own), own) and ids[r.doc_id][0] == len(own)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_whole_table_matches_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for d in docs.collect():
        own, text = want(d.text)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_a_vocabulary_of_another_kind_is_refused(tmp_path):
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}):
        spec = json.loads(open(PATH, encoding="utf-8").read()) | change
        (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / "v.json"))


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"].reverse()
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))
