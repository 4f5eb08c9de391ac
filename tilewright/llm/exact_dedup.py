"""Exact dedup by content-defined chunk recipes.

A text is cut where its own characters say so, so equal passages give equal chunks wherever they stand. Chunks are
deduplicated to 64-bit identifiers, each verified against 128 bits of the SHA-256 of its chunk; documents are then
compared by their ordered identifier lists, about a fiftieth of the texts, and by their own SHA-256 as the last check.
Texts are read once and never move.

Defined results: a null text counts as empty and empty texts form one group; repeated rows count in group_size and rows
that repeat the largest doc_id share its verdict; rows without an id never stay while a row with one has the same text,
and a group of only such rows keeps them all with keep_id null; an empty table gives an empty result; other columns are
not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, may_hold, written

#: A cut stands after a line's end, or between words of which one ends in a-e and the next starts with s-z; chunks
#: have at least MIN_CHUNK characters, except a text's last, and at most MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    cut = r"(?:(?<=\n)|(?<=[a-e][ \n])(?=[s-z]))"
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?{cut}|.{{1,{most}}}"), F.lit(0))


def chunk_store(listed: DataFrame) -> DataFrame:
    """(key, check): each distinct chunk of the column _chunks once, as its 64-bit key and 128 bits of its SHA-256."""
    return listed.select(F.explode("_chunks").alias("c")).select("c.key", "c.check").distinct()


def conflicts(store: DataFrame) -> DataFrame:
    """Keys that stand for more than one chunk. At 64 bits there are none in practice; they are looked for all the same."""
    return store.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered verified identifiers of each row's chunks.

    An identifier is the chunk's 64-bit key where the store has that key for one chunk only. Where it finds conflicts,
    the keys of all chunks take the digest in. Texts are read once; what follows works on the table of keys.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    listed = df.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select("doc_id", F.sha2("_text", 256).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks"))
    both = F.transform("_chunks", lambda c: F.struct(F.xxhash64(c).alias("key"), F.unhex(F.substring(F.sha2(c, 256), 1, 32)).alias("check")))
    listed = written(listed.select("doc_id", F.unhex("text_sha256").alias("_sha"), both.alias("_chunks")), "recipes")
    sound = conflicts(chunk_store(listed)).isEmpty()
    ids = F.transform("_chunks", lambda c: c["key"] if sound else F.xxhash64(c["key"], c["check"]))
    return listed.select("doc_id", F.lower(F.hex("_sha")).alias("text_sha256"), ids.alias("recipe"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Groups are pre-aggregated before the shuffle; those with copies are written and joined back, so a group of a third of
    all rows is one row on one side, broadcast or not by its measured size, and splits on the other.
    """
    listed = recipes(df, id_col, text_col)
    groups = listed.groupBy("recipe", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.filter("group_size > 1").select(F.col("recipe").alias("_r"), F.col("text_sha256").alias("_s"), "keep_id", "group_size"), "copies")
    both = listed.join(groups, (listed["recipe"] == groups["_r"]) & (listed["text_sha256"] == groups["_s"]), "left")
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_dedup drops; columns as they were. Rows whose ids are not among the dropped ones pass without a shuffle."""
    gone = exact_dedup(df, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_sha")).distinct()
    gone = written(gone, "dropped")
    touched = may_hold(gone.select(F.xxhash64("_gone").alias("k")), "k")(F.xxhash64(F.col(id_col)))
    some = df.filter(touched)
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    return df.filter(~touched).unionByName(some.join(gone, some[id_col].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
