"""Hashes, RESP and tokenisers against plain Python."""

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import hashing, lines, resp
from tidelog.operators.flow import token_bucket

KEYS = ["", "a", "ab", "abc", "abcd", "user:17", "héé", "日本", "order:00000042", "x" * 70]
MASK = (1 << 64) - 1


def signed(b):
    return (b - 256 if b > 127 else b) & MASK


def fnv1a(key):
    h = 14695981039346656037
    for b in key.encode():
        h = ((h ^ signed(b)) * 1099511628211) & MASK
    return h


def djb2(key):
    h = 5381
    for b in key.encode():
        h = (h * 33 + signed(b)) & MASK
    return h


def murmur(key):
    data, m, h, word = key.encode(), 0x5BD1E995, 0, (1 << 32) - 1
    while len(data) >= 4:
        k = int.from_bytes(data[:4], "little") * m & word
        k = (k ^ k >> 24) * m & word
        h, data = (h * m & word) ^ k, data[4:]
    if data:
        h = (h ^ int.from_bytes(data, "little")) * m & word
    h = (h ^ h >> 13) * m & word
    return h ^ h >> 15


def test_hashes():
    s = pd.Series(KEYS)
    assert hashing.fnv1a(s).tolist() == [fnv1a(k) for k in KEYS]
    assert hashing.djb2(s).tolist() == [djb2(k) for k in KEYS]
    assert hashing.murmur(s).tolist() == [murmur(k) for k in KEYS]
    assert fnv1a("a") == 0xAF63DC4C8601EC8C


def test_poly31_and_positions(spark):
    df = spark.createDataFrame([(k, 1437, 6) for k in KEYS], "k string, bits long, hashes long")
    rows = df.select("k", hashing.poly31(F.col("k"), 16).alias("shard"), hashing.bloom_positions("k", "bits", "hashes").alias("p")).collect()
    for r in rows:
        h = 0
        for b in r.k.encode():
            h = (h * 31 + b) % (1 << 32)
        assert r.shard == h % 16
        assert r.p == [((fnv1a(r.k) + i * djb2(r.k)) & MASK) % 1437 for i in range(6)]


def wire(value):
    kind, x = value
    if kind in ("simple", "error"):
        return ("+" if kind == "simple" else "-") + x + "\r\n"
    if kind == "integer":
        return f":{x}\r\n"
    if x is None:
        return "$-1\r\n" if kind == "bulk" else "*-1\r\n"
    if kind == "bulk":
        return f"${len(x.encode())}\r\n{x}\r\n"
    return f"*{len(x)}\r\n" + "".join(map(wire, x))


PLAIN = st.text(st.characters(exclude_characters="\r\n", exclude_categories=("Cs",)), max_size=8)
VALUES = st.recursive(
    st.one_of(st.tuples(st.just("simple"), PLAIN), st.tuples(st.just("error"), PLAIN), st.tuples(st.just("integer"), st.integers(-(1 << 63), (1 << 63) - 1)), st.tuples(st.just("bulk"), st.none() | st.text(st.characters(exclude_categories=("Cs",)), max_size=12)), st.just(("array", None))),
    lambda inner: st.tuples(st.just("array"), st.lists(inner, max_size=4)),
    max_leaves=8,
)


@given(VALUES)
def test_round_trip(value):
    data = wire(value).encode()
    assert resp.parse(data) == (value, len(data))
    for cut in range(len(data)):
        with pytest.raises((resp.Incomplete, resp.Malformed)):
            resp.parse(data[:cut])


@pytest.mark.parametrize("data,why", [("*1\r\n$3\r\nab", "incomplete"), ("x\r\n", "malformed"), ("$x\r\n", "malformed"), ("$2\r\nabXX", "malformed"), ("*-2\r\n", "malformed"), (":\r\n", "malformed")])
def test_bad_buffers_say_why(spark, data, why):
    resp.register(spark)
    rows = spark.sql("SELECT v.* FROM (SELECT :b AS buffer), LATERAL resp_values(buffer) AS v", args={"b": "+OK\r\n" + data}).collect()
    assert [r.status for r in rows] == ["ok", why] and rows[0].shown == "OK"


def test_encode_and_decode_in_the_jvm(spark):
    args = [["SET", "k", "v"], ["GET", "ключ", ""], ["A", None, "é\r\n$1"]]
    df = spark.createDataFrame([(a,) for a in args], "args array<string>").select("args", resp.command(F.col("args")).alias("wire"))
    for r in df.select("*", resp.arguments("wire").alias("back"), F.array(*resp.flat_arguments(F.col("wire"), 3)).alias("flat")).collect():
        assert r.back == r.args and r.flat == (r.args if None not in r.args else [r.args[0], None, None])


def quoted(line):
    out, word, inside = [], "", False
    for c in line:
        if c == '"':
            inside = not inside
        elif c == " " and not inside:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def test_tokenisers(spark):
    cases = ['SET k "a b"', '"open end', "", "  ", 'a""b c', '"" x']
    rows = spark.createDataFrame([(c,) for c in cases], "line string").select("line", lines.quoted_tokens("line").alias("t"), lines.blank_tokens(F.col("line")).alias("w")).collect()
    for r in rows:
        assert r.t == quoted(r.line) and r.w == r.line.split()


def test_token_bucket(spark):
    at = [0, 0, 0, 0, 900_000, 1_000_000, 1_500_000, 2_100_000, 2_200_000, 60_000_000, 60_000_000, 60_000_000, 60_000_000]
    rows = token_bucket(spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "who long, seq long, at long"), 1, 3).orderBy("seq").collect()
    assert [r.admitted for r in rows] == [True, True, True, False, False, True, False, True, False, True, True, True, False]
