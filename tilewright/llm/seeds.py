"""Word hashes, shingles and winnowed anchors in NumPy, and bounded bitmaps that thin out what is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k consecutive numbers, none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(seed * 2 + k), dtype=np.uint64)
        for i in range(k):
            out = out * _ODD + h[i : i + n]
    return mixed(out)


def minimizers(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive numbers, the place of its least; the leftmost, on ties."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, wide = g, 1
    while 2 * wide <= w:  # least of 2, 4, 8, ... consecutive numbers
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < w:
        least = np.minimum(least[:n], least[w - wide : w - wide + n])
    best = np.full(n, w - 1, dtype=np.int64)
    for i in range(w - 2, -1, -1):
        best[g[i : i + n] == least] = i
    return best + np.arange(n)


def bitmap(keys: DataFrame, col: str, bits: int = BITS) -> bytes:
    """A bitmap of 2**bits bits with the low bits of each key set: built by the executors, at most 2**bits / 8 bytes come to the driver whatever the input is."""
    slot = F.pmod(F.col(col), F.lit(1 << bits)) + 1
    rows = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    out = np.zeros(((1 << bits) >> 15, 4096), dtype=np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(r.m, dtype=np.uint8)
    return out.tobytes()


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bitmap may hold: no false negatives."""
    slot = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def texts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a few rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
