"""Hashes of all words of a batch of texts, in NumPy: no Python object per word.

A word's hash is a polynomial of its bytes' random 64-bit numbers, from one running sum over the block, made independent
of its place by the inverse of the power it starts at, and then mixed. Words are runs of bytes other than ASCII white
space, as bytes.split() gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .seeds import mixed

#: Bytes that are hashed at a time; a longer text goes in pieces cut at white space.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_STEP, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        for i, x in enumerate((_STEP, _BACK)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def runs(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices x[start:end] of 64-bit numbers, in their order."""
    p, q = powers(len(x) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * p[: len(x)], out=total[1:])
        return mixed((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * _LENGTH)


def _block(data: np.ndarray, starts_at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first byte) of the words of a block; starts_at: where its documents start."""
    black = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts_at] = True
    edge[0] = edge[-1] = True
    before = np.empty_like(black)
    before[:1], before[1:] = False, black[:-1]
    after = np.empty_like(black)
    after[-1:], after[:-1] = False, black[1:]
    start = np.flatnonzero(black & (~before | edge[:-1]))
    end = np.flatnonzero(black & (~after | edge[1:])) + 1
    return runs(table[data], start, end), start


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about BLOCK bytes that end at white space."""
    at = 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data):
            white = np.flatnonzero(_WHITE[data[at:stop]])
            if len(white):
                stop = at + int(white[-1]) + 1
                break
            stop = min(stop + BLOCK, len(data))  # a word longer than a block
        yield data[at:stop]
        at = stop


def hashed(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) of some rows at a time: row first + i has the hashes from offsets[i] to offsets[i + 1]. lower: A-Z count as a-z. Nulls have no words."""
    column = column.fill_null("")
    table = _LOWER if lower else _BYTES
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and offs[-1] else np.empty(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + BLOCK, side="right")) - 1)
        stop = min(stop, n)
        data = raw[offs[row] : offs[stop]]
        if stop == row + 1 and len(data) > BLOCK:
            found = np.concatenate([_block(p, np.zeros(0, np.int64), table)[0] for p in _pieces(data)])
            yield row, found, np.array([0, len(found)])
        elif len(data):
            found, start = _block(data, offs[row:stop] - offs[row], table)
            yield row, found, np.searchsorted(start, offs[row : stop + 1] - offs[row])
        else:
            yield row, np.empty(0, np.uint64), np.zeros(stop - row + 1, dtype=np.int64)
        row = stop
