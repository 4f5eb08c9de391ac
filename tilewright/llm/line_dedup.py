"""Line dedup with overlapping three-line windows.

The lines that hold a word, without white space at their ends, form overlapping windows of three. A window that occurs
more than once anywhere in the corpus keeps its first occurrence; the lines that later occurrences cover are removed,
their positions merged. First is the least (doc_id, digest of the text, position).

Defined results: a null text has no lines; lines without a word belong to no window and stay; texts with under three
lines stay whole; a null id comes before all others; rows that repeat an id and a text count as one and get equal rows;
an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_hold, once, without, written

LINES = 3


def windows(df: DataFrame) -> DataFrame:
    """(doc_id, digest, w, k1, k2): each window of the columns doc_id, text; w is its line numbers."""
    held = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("i"), F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "").alias("s"))), lambda x: x["s"] != "")
    d = df.select("doc_id", F.xxhash64("text").alias("digest"), held.alias("l")).filter(F.size("l") >= LINES)
    d = d.select("doc_id", "digest", F.explode(F.transform(F.slice("l", 1, F.size("l") - (LINES - 1)), lambda x, j: F.struct(x.alias("a"), F.get("l", j + 1).alias("b"), F.get("l", j + 2).alias("c")))).alias("x"))
    lines = [F.col("x.a.s"), F.col("x.b.s"), F.col("x.c.s")]
    return d.select("doc_id", "digest", F.array("x.a.i", "x.b.i", "x.c.i").alias("w"), F.xxhash64(*lines).alias("k1"), F.xxhash64(F.lit(1), *lines).alias("k2"))


def repeated_lines(df: DataFrame) -> DataFrame:
    """(doc_id, digest, gone): the line numbers that later occurrences of windows cover. Window keys are counted before they are shuffled; only repeated ones are joined back."""
    every = windows(df)
    place = F.struct("doc_id", "digest", F.element_at("w", 1).alias("at"))
    first = every.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("k1", "k2", "first")
    first = written(first, "windows")
    later = every.join(first, ["k1", "k2"]).filter(place != F.col("first"))
    return later.select("doc_id", "digest", F.explode("w").alias("i")).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("i")).alias("gone"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (the lines that stay). Only texts whose ids may lose lines are shuffled, the others pass."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = written(repeated_lines(docs), "repeated").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), "gone")
    touched = may_hold(gone.select(F.xxhash64("_id").alias("k")), "k")(F.xxhash64("doc_id"))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines")
    rest = docs.filter(~touched).select("doc_id", n_lines, F.lit(0).cast("long").alias("n_removed"), "text")

    some = docs.filter(touched)
    some = some.join(gone, some["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64("text") == gone["_d"]), "left")
    some = some.select("doc_id", n_lines, "text", "gone", once(F.split("text", "\n")).alias("_l"))
    stay = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("_l"), F.col("gone")), "\n"))
    return rest.unionByName(some.select("doc_id", "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), stay.alias("text")))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT doc_id, i, regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS s FROM l),
w AS (SELECT doc_id, i, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3,
             s || chr(10) || lead(s) OVER o || chr(10) || lead(s, 2) OVER o AS k
      FROM h WHERE s <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w WHERE k IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM r WHERE n > 1)
SELECT l.doc_id, CASE WHEN any_value(text) = '' OR any_value(text) IS NULL THEN 0 ELSE count(*) END AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN s END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
