"""Byte-level BPE encoding and decoding with a segment tree.

A text is split by the tokenizer's pattern; each piece is merged on its own. A segment tree over the piece's byte
positions stores the leftmost minimum pair rank, so the next merge is at the root, and each merge updates only the live
neighbours, in logarithmic time: a piece of n bytes costs n log n however long it is. Pieces repeat, so each Python
worker remembers the short ones it has merged, up to a fixed number.

Defined results: a null or empty text has no ids and decodes to no bytes; lone surrogates cannot occur in Spark strings;
rows that repeat an id are encoded each; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Pieces of up to SHORT characters are remembered when they come again: a worker has two generations of REMEMBERED each, some 50 MB at most, and MET bytes for which came once.
SHORT, REMEMBERED, MET = 24, 174_000, 1 << 20
#: Bytes of text, and ids, that a worker takes at a time; a longer row goes alone.
TEXT, IDS = 1 << 20, 1 << 18
#: Characters from which on a text's pieces are taken one by one, without a list of them all.
LONG = 1 << 16
_NONE = 1 << 62
pack = partial(array, "i")

#: The characters that \s stands for.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The rank file: a line has a token in base64 and its rank."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x.strip())}


def splitters(pattern: str):
    """Two compiled forms of a pattern, for any text and a faster one for ASCII, where both find the same pieces."""
    full = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
    plain = pattern.replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9")
    plain = re.sub(r" \?(A-Za-z|0-9)\+", r" ?[\1]+", plain).replace("[^\\s", "[^\\t-\\r ").replace("\\S", "[^\\t-\\r ]").replace("\\s", "[\\t-\\r ]")
    return regex.compile(full), (re.compile(plain) if "\\p" not in plain else regex.compile(full))


class SegmentTree:
    """Leftmost minimum over n places, each with a rank or none. A node holds rank * size + place, so the least number is the leftmost minimum."""

    def __init__(self, ranks: list[int | None]):
        self.size = size = 1 << max(1, (len(ranks) - 1).bit_length())
        self.tree = tree = [_NONE] * (2 * size)
        for i, r in enumerate(ranks):
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def least(self) -> int:
        """The place of the leftmost minimum, or -1 if no place has a rank."""
        top = self.tree[1]
        return -1 if top == _NONE else top & (self.size - 1)

    def put(self, place: int, rank: int | None) -> None:
        tree, i = self.tree, self.size + place
        least = tree[i] = _NONE if rank is None else rank * self.size + place
        while i > 1:
            other = tree[i ^ 1]
            if other < least:
                least = other
            i >>= 1
            if tree[i] == least:
                break
            tree[i] = least


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # of the token that starts at a live place
    before = list(range(-1, n - 1))  # the live place before
    tree = SegmentTree([get(piece[i : i + 2]) for i in range(n - 1)])
    put, nodes, mask = tree.put, tree.tree, tree.size - 1
    while (top := nodes[1]) != _NONE:
        i = top & mask
        j = end[i]  # the token at j joins the one at i
        stop = end[i] = end[j]
        if j < n - 1 and nodes[mask + 1 + j] != _NONE:
            put(j, None)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]]))
        else:
            put(i, None)
        if (p := before[i]) >= 0:
            put(p, get(piece[p:stop]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, (self.full, self.plain) = ranks, splitters(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met = bytearray(MET)

    def ids(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        known, out, split = self.known, bytearray(), self.plain if text.isascii() else self.full
        for piece in split.findall(text) if len(text) < LONG else (m.group() for m in split.finditer(text)):
            got = known.get(piece)
            if got is None:
                got, slot = self.older.get(piece), hash(piece) % MET
                new = got is None and not self.met[slot]
                if got is None:
                    got, self.met[slot] = pack(merge(piece.encode(), self.ranks)).tobytes(), 1
                if len(piece) <= SHORT and not new:  # most pieces come once
                    if len(known) >= REMEMBERED:
                        self.older, self.known, self.met = known, (known := {}), bytearray(MET)
                    known[piece] = got
            out += got
        return bytes(out)

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shipped, pattern: str) -> Encoder:
    """One encoder for each rank file and pattern in a worker process."""
    key = hash((shipped.value, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(shipped.value), pattern)
    return _ENCODERS[key]


def _lists(parts: list[bytes]) -> pa.Array:
    """Lists of 32-bit integers of their bytes; several chunks are not needed, a batch's ids stay under 2^31."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def _in_bounds(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` of the rows' sizes each, and one row at least."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each row's text. The rank file, under a megabyte, is read by the driver and broadcast."""
    small_batches(df.sparkSession)
    with open(ranks_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shipped, pattern)
        for whole in batches:
            for batch in _in_bounds(whole, pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), TEXT):
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists([enc.ids(t) if t else b"" for t in batch.column(1).to_pylist()])], ["doc_id", "ids"])

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded): the bytes that each row's ids stand for; null ids are none."""
    small_batches(df.sparkSession)
    with open(ranks_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shipped, pattern)
        for batch in batches:
            for part in _in_bounds(batch, pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), IDS):
                texts = [enc.text(x.values.to_numpy()) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
