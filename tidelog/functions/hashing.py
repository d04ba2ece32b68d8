"""Key hashes of the store's dialects.

poly31 stays a JVM expression. The 64-bit ones wrap, which ANSI arithmetic
refuses, so they run as vectorised UDFs over Arrow batches: one NumPy step for
each byte position of the longest key of a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType


def poly31(key: Column, modulus: int) -> Column:
    """h = 31 h + byte in 32 bits, then modulo: the shard (16) or filter segment (4) of a key."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(key, "utf-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296) % modulus).cast("int")


def _bytes(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = [k.encode("utf-8") for k in keys.fillna("")]
    size = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), int(size.max(initial=0)) + 4), np.uint8)
    for i, r in enumerate(raw):
        out[i, : len(r)] = np.frombuffer(r, np.uint8)
    return out, size


def _signed(column: np.ndarray) -> np.ndarray:
    """A byte as a signed character widened to 64 bits."""
    return column.astype(np.int8).astype(np.int64).view(np.uint64)


def fnv1a(keys: pd.Series) -> np.ndarray:
    data, size = _bytes(keys)
    h = np.full(len(data), 14695981039346656037, np.uint64)
    for i in range(int(size.max(initial=0))):
        h = np.where(i < size, (h ^ _signed(data[:, i])) * np.uint64(1099511628211), h)
    return h


def djb2(keys: pd.Series) -> np.ndarray:
    data, size = _bytes(keys)
    h = np.full(len(data), 5381, np.uint64)
    for i in range(int(size.max(initial=0))):
        h = np.where(i < size, h * np.uint64(33) + _signed(data[:, i]), h)
    return h


def murmur(keys: pd.Series) -> np.ndarray:
    """32-bit multiply-and-shift hash of little-endian words with seed 0."""
    data, size = _bytes(keys)
    m, h = np.uint32(0x5BD1E995), np.zeros(len(data), np.uint32)
    whole = size // 4
    for i in range(int(whole.max(initial=0))):
        k = data[:, 4 * i : 4 * i + 4].copy().view("<u4")[:, 0] * m
        k = (k ^ (k >> np.uint32(24))) * m
        h = np.where(i < whole, (h * m) ^ k, h)
    rest, base = size % 4, 4 * whole
    rows = np.arange(len(data))
    for j in (2, 1, 0):
        h = np.where(rest > j, h ^ (data[rows, base + j].astype(np.uint32) << np.uint32(8 * j)), h)
    h = np.where(rest > 0, h * m, h)
    h = (h ^ (h >> np.uint32(13))) * m
    return h ^ (h >> np.uint32(15))


@pandas_udf(IntegerType())
def cache_segment(keys: pd.Series) -> pd.Series:
    """The cache segment (of 4) of each key."""
    return pd.Series((murmur(keys) % np.uint32(4)).astype(np.int32))


@pandas_udf(ArrayType(LongType()))
def bloom_positions(keys: pd.Series, bits: pd.Series, hashes: pd.Series) -> pd.Series:
    """Bit positions of each key by double hashing, (h1 + i h2) modulo the number of bits, wrapping at 2**64."""
    h1, h2, m = fnv1a(keys), djb2(keys), bits.to_numpy().astype(np.uint64)
    every = np.stack([(h1 + np.uint64(i) * h2) % m for i in range(int(hashes.max()) if len(hashes) else 0)], axis=1).astype(np.int64)
    return pd.Series([row[:n] for row, n in zip(every, hashes, strict=True)])
