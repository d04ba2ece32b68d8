"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (by
multiplication) its three letters' vectors, permuted (rolled) by two, one and
no places; a text's vector bundles (adds) the vectors of its trigrams. A
language's prototype bundles the normalised vectors of its texts, and a text
is given the language of the prototype with the greatest cosine. Anything that
is not a letter ends a word; a word's ends count as a letter of their own.

The fit uses at most about ``FIT_ROWS`` rows, chosen by a hash of their id;
each task sends the driver one sum a language. Prediction is one narrow map.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text if nothing could be learned; equal cosines go to the
smaller language; rows with a null id or lang teach nothing; ``held_out`` of a
null id is false; repeated rows each get their row; long texts count whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import fold_of
from tidelog.llm.words import flat, steps

FIT_ROWS = 20_000
DIMENSIONS = 512
SYMBOLS = 256
UNKNOWN = "und"
_PAIRS = 1 << 14


class _Letters:
    """Made on first use in each process: the symbol of each code point (0: no letter) and the symbols' vectors."""

    symbol: np.ndarray | None = None
    vectors: list[np.ndarray]

    @classmethod
    def get(cls) -> type[_Letters]:
        if cls.symbol is None:
            cls.vectors = []
            base = np.random.default_rng(977).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.float32) * 2 - 1
            cls.vectors = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
            table = np.zeros(0x110000, np.uint8)
            for c in range(0x110000):
                if (x := chr(c)).isalpha():
                    low = ord(x.lower()[0])
                    table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
            cls.symbol = table
        return cls


def profiles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and how many letters it has."""
    letters = _Letters.get()
    raw, offsets = flat(column)
    n = len(offsets) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    s = letters.symbol[points].astype(np.int64)
    before, after = np.zeros_like(s), np.zeros_like(s)
    before[1:], after[:-1] = s[:-1], s[1:]
    inner = at[(at > 0) & (at < len(s))]
    before[inner], after[inner - 1] = 0, 0
    doc = np.repeat(np.arange(n), np.diff(at))
    is_letter = s > 0
    keys = ((doc << 24) | (before << 16) | (s << 8) | after)[is_letter]
    keys, times = np.unique(keys, return_counts=True)
    doc, gram = keys >> 24, keys & 0xFFFFFF
    out = np.zeros((n, DIMENSIONS), np.float32)
    for first in range(0, n, 512):
        a, b = np.searchsorted(doc, (first, first + 512))
        if a < b:
            _bundle(out, doc[a:b], gram[a:b], times[a:b].astype(np.float32))
    return out, np.bincount(keys >> 24, weights=times, minlength=n)


def _bundle(out: np.ndarray, doc: np.ndarray, gram: np.ndarray, times: np.ndarray) -> None:
    own, column = np.unique(gram, return_inverse=True)
    v3, v2, v1 = _Letters.get().vectors
    docs = int(doc[-1] - doc[0]) + 1
    if len(doc) * 40 >= docs * len(own):
        bound = v3[own >> 16] * v2[(own >> 8) & 255] * v1[own & 255]
        count = np.zeros((docs, len(own)), np.float32)
        count[doc - doc[0], column] = times
        out[doc[0] : doc[0] + docs] += count @ bound
        return
    for k in range(0, len(doc), _PAIRS):
        d, g = doc[k : k + _PAIRS], gram[k : k + _PAIRS]
        rows = v3[g >> 16] * v2[(g >> 8) & 255] * v1[g & 255] * times[k : k + _PAIRS, None]
        new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out[d[new]] += np.add.reduceat(rows, new, axis=0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A prototype of each language, learned outside the held-out fifth."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(fold_of("doc_id", 5) != 0)
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                x = _unit(profiles(part.column("text"))[0])
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + x[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))], names=["lang", "x"])

    out: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "text").mapInArrow(add, "lang string, x array<double>").collect():
        out[r.lang] = out.get(r.lang, 0) + np.array(r.x)
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) of every document."""
    names = np.array([*prototypes, UNKNOWN], object)
    matrix = _unit(np.array(list(prototypes.values())).reshape(-1, DIMENSIONS)).astype(np.float32).T

    def guess(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                x, n = profiles(part.column("text"))
                if matrix.shape[1]:
                    cosine = _unit(x) @ matrix
                    best = np.where(n > 0, cosine.argmax(axis=1), len(names) - 1)
                    score = np.where(n > 0, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
                else:
                    best, score = np.zeros(len(n), int), np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return rows.mapInArrow(guess, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")
