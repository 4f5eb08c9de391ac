"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of each 13-word window, the least hash of its 5-word sequences. Two equal windows have the
same anchor at the same place, so a repeat of 13 words cannot be missed. Anchors that only one document has are dropped
first. The rest extend both ways: all windows that chose one anchor occurrence are a stretch, and equal stretches extend
each other at once. Only anchors that stand in different stretches, at the ends of repeats, are extended window by
window. Adjoining repeated windows make up the maximal repeats.

Nothing works on pairs of documents: anchors, stretches and windows are grouped by content, with the smallest doc_id
pre-aggregated, so a passage in a third of all documents costs as much as its occurrences. Two bitmaps of fixed size
keep unshared anchors and untouched documents out of the shuffles; they only ever let too much through.

Defined results: a null text has no words; texts under 13 words stay whole; rows with a null id stay whole and are
nobody's original; rows that repeat an id count as one document; an empty table gives an empty result; other columns are
not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .seeds import bitmap, grams, hits, minimizers, texts
from .words import hashed, runs

#: Words of a window; words of an anchor.
LENGTH, ANCHOR = 13, 5


def _digest(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) & (2**63 - 1)


def _stretches(h: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(doc, anchor, start, n, content, windows, place) of the stretches of some documents with word hashes h and offsets at.

    doc counts from 0, start is the stretch's first window within its document, n its number of windows, content a hash
    of them; windows are the hashes of all windows of h, in which the stretch's stand from `place` on.
    """
    g, win = grams(h, k), grams(h, length, seed=1)
    if not len(win):
        return (np.empty(0, np.int64),) * 7
    best = minimizers(g, length - k + 1)
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(win)]
    stop = at[1:][doc] - length + 1  # past the document's last window
    place = np.arange(len(win))
    valid = place < stop
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (best[1:] != best[:-1])
    start = np.flatnonzero(fresh)
    end = np.minimum(np.append(start[1:], len(win)), stop[start])
    d = doc[start]
    return d, g[best[start]], start - at[:-1][d], end - start, runs(win, start, end), win, start


def anchors(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(anchor, doc_id): the documents' anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = _ids(batch)
            for row, h, at in hashed(batch.column(1)):
                doc, anchor, *_ = _stretches(h, at, length, k)
                keep = known[row + doc]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(ids[row + doc[keep]])], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor bigint, doc_id bigint")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 for null ones, and which are known."""
    c = batch.column(0)
    return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)


def stretches(docs: DataFrame, shared: bytes, windows: bool = False, whole: bool = False, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(anchor, content, doc_id, digest, start, n[, hashes]) of the stretches whose anchor, or with whole whose content, the bitmap may hold."""
    bits = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            ids, known = _ids(batch)
            for row, h, at in hashed(batch.column(1)):
                doc, anchor, start, n, content, win, place = _stretches(h, at, length, k)
                keep = np.flatnonzero(known[row + doc] & hits(held, content if whole else anchor)) if len(doc) else doc
                if not len(keep):
                    continue
                digests = np.array([_digest(t) for t in batch.column(1).slice(row, len(at) - 1).to_pylist()], dtype=np.int64)
                out = [pa.array(x) for x in (anchor[keep].view(np.int64), content[keep].view(np.int64), ids[row + doc[keep]], digests[doc[keep]], start[keep].astype(np.int32), n[keep].astype(np.int32))]
                if windows:
                    ends = np.zeros(len(keep) + 1, dtype=np.int32)
                    np.cumsum(n[keep], out=ends[1:])
                    each = np.repeat(place[keep] - ends[:-1], n[keep]) + np.arange(ends[-1])
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(win[each].view(np.int64))))
                yield pa.RecordBatch.from_arrays(out, ["anchor", "content", "doc_id", "digest", "start", "n", *["hashes"] * windows])

    return docs.mapInArrow(run, "anchor bigint, content bigint, doc_id bigint, digest bigint, start int, n int" + ", hashes array<bigint>" * windows)


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, digest, spans): first window and number of windows of what an earlier document says too; the spans of columns doc_id, text."""
    first = anchors(docs, length, k).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    found = stretches(docs, bitmap(first, "anchor"), length=length, k=k)

    # stretches that are equal as a whole: all but the earliest document's are repeats; they are looked for in the texts
    # once more, which moves less than keeping all that the anchors bring up
    same = written(found.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "contents")
    copied = written(same.filter("first < last").select(F.col("anchor").alias("_a"), F.col("content").alias("_c"), "first"), "copied")
    again = stretches(docs, bitmap(copied, "_c"), whole=True, length=length, k=k)
    whole = again.join(copied, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c"))).filter("doc_id > first").select("doc_id", "digest", "start", "n")

    # anchors in different stretches: their earliest documents' windows, one by one
    differ = written(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("first").alias("x"), F.max("first").alias("y")).filter("m > 1 and x < y").select("anchor"), "ends")
    ends = stretches(docs, bitmap(differ, "anchor"), windows=True, length=length, k=k)
    # only the earliest document of each stretch: others are repeats as a whole
    ends = ends.join(same.select(F.col("anchor").alias("_a"), F.col("content").alias("_c"), "first"), (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")) & (F.col("doc_id") == F.col("first")), "left_semi")
    windows = written(ends.select("anchor", "doc_id", "digest", "start", F.posexplode("hashes").alias("off", "window")), "windows")
    source = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    source = written(source.select(F.col("anchor").alias("_a"), F.col("window").alias("_w"), "first"), "sources")
    single = windows.join(source, (F.col("anchor") == F.col("_a")) & (F.col("window") == F.col("_w"))).filter("doc_id > first").select("doc_id", "digest", (F.col("start") + F.col("off")).alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def maximal(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """(first word, end) of the maximal repeats that windows (first window, number) make up."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][1] - length + 1:
            out[-1][1] = max(out[-1][1], s + n + length - 1)
        else:
            out.append([s, s + n + length - 1])
    return [(a, b) for a, b in out]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, repeats (first word, end), kept_sha256 (of the kept words, joined by one space), text (the kept words, null where nothing was removed and the text stands)."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    spans = written(repeats(docs, length, k), "spans")
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "doc_id"))
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, repeats array<struct<first:bigint,end:bigint>>, kept_sha256 string, text string"
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_words", "n_removed", "repeats", "kept_sha256", "text"]

    def rows(ids: list, bodies: list, all_spans: list) -> pa.RecordBatch:
        out = []
        for i, t, got in zip(ids, bodies, all_spans, strict=True):
            words, cut = (t or "").encode().split(), maximal([(x["start"], x["n"]) for x in got or ()], length)
            kept, at = [], 0
            for a, b in cut:
                # repeats may overlap in words though their windows don't adjoin
                kept += words[at:a] if a > at else []
                at = max(at, b)
            line = b" ".join(kept + words[at:])
            out.append((i, len(words), len(words) - (line.count(b" ") + 1 if line else 0), [{"first": a, "end": b} for a, b in cut], hashlib.sha256(line).hexdigest(), line.decode() if cut else None))
        c = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], kind), pa.array(c[4], pa.string()), pa.array(c[5], pa.string())], names)

    def may(ids: list) -> np.ndarray:
        held = np.frombuffer(touched.value, dtype=np.uint8)
        return hits(held, np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64)) & np.array([i is not None for i in ids], dtype=bool)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in texts(batches):
            keep = np.flatnonzero(~may(ids))
            yield rows([ids[j] for j in keep], [bodies[j] for j in keep], [None] * len(keep))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in texts(batches):
            keep = np.flatnonzero(may(ids))
            part = [bodies[j] for j in keep]
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in keep], pa.int64()), pa.array(part, pa.string()), pa.array([_digest(t) for t in part], pa.int64())], ["doc_id", "text", "digest"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 64):
                yield rows(*[c.to_pylist() for c in batch.slice(j, 64).columns])

    hit = docs.mapInArrow(candidates, "doc_id bigint, text string, digest bigint")
    mine = spans.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"), "spans")
    hit = hit.join(mine, (F.col("doc_id") == F.col("_i")) & (F.col("digest") == F.col("_d")), "left").select("doc_id", "text", "spans")
    return docs.mapInArrow(untouched, ddl).unionByName(hit.mapInArrow(cut_out, ddl))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
