"""Quality rules, with cross-document line frequency.

Each line is normalised and hashed; per host, the documents that hold it are counted, copies of one text once. Lines
held by more than a share of the host's documents are boiler-plate and come off; a document that keeps too little is
rejected, as is one that fails the base rules. Everything is DataFrame expressions: repeated 8-word windows are found
inside each row by sorting window hashes, so no window ever moves.

Defined results: a null text has no words and fails; a null host is a host of its own; rows that repeat an id and a text
get equal rows; a null id is kept as null; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, may_hold, once, without, words_of, written

#: A line is boiler-plate in more than MIN_DOCS of its host's distinct texts, if they are also more than a share that
#: falls with their number: PER_ROOT over its square root, LEAST_SHARE at least. Of 4 texts all, of 100 16, of 500 34.
MIN_DOCS, PER_ROOT, LEAST_SHARE = 3, 1.5, 0.01
#: A document is depleted that loses a line and then has under MIN_LEFT words, or under MIN_LEFT_SHARE of its words.
MIN_LEFT, MIN_LEFT_SHARE = 20, 0.4
WINDOW = 8


def _lines(df: DataFrame) -> DataFrame:
    """(doc_id, _digest, host, pos, _h, _h2, line_words) of each line with a word."""
    has = F.filter(F.transform(F.split("_text", "\n"), lambda s, i: F.struct(i.alias("pos"), s.alias("line"))), lambda x: x["line"].rlike(NOT_SPACE))
    line = F.lower(F.trim(F.regexp_replace("x.line", f"{SPACE}+", " ")))
    flat = df.select("doc_id", "_digest", "host", F.explode(has).alias("x")).select("doc_id", "_digest", "host", F.col("x.pos").alias("pos"), line.alias("_line"))
    return flat.select("doc_id", "_digest", "host", "pos", F.xxhash64("_line").alias("_h"), F.hash("_line").alias("_h2"), (F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + 1).alias("line_words"))


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS, per_root: float = PER_ROOT, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, _h, _h2) of the lines above the limits. Equal texts of a host count as one document."""
    per = lines.groupBy("host", "_h", "_h2").agg(F.countDistinct("_digest").alias("n"))
    hosts = docs.groupBy("host").agg(F.countDistinct("_digest").alias("of"))
    limit = F.greatest(per_root * F.sqrt("of"), least_share * F.col("of"))
    over = per.filter(F.col("n") > min_docs).join(hosts, per["host"].eqNullSafe(hosts["host"])).filter(F.col("n") > limit)
    return over.select(per["host"], "_h", "_h2")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """(doc_id, _digest, lost, positions) of the rows that lose lines: words lost and line numbers from 0."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    docs = docs.withColumn("_digest", F.xxhash64("_text"))
    lines = _lines(docs)
    often = written(frequent_lines(lines, docs, **limits), "lines").withColumnRenamed("host", "_host")
    hit = lines.join(often, lines["host"].eqNullSafe(often["_host"]) & (lines["_h"] == often["_h"]) & (lines["_h2"] == often["_h2"]), "left_semi")
    return hit.groupBy("doc_id", "_digest").agg(F.collect_set(F.struct("pos", "line_words")).alias("s")).select(
        "doc_id", "_digest", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["line_words"]).alias("lost"), F.transform("s", lambda x: x["pos"]).alias("positions")
    )


def base_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Counts of each row: doc_id, _digest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; with carry, the row itself as the struct _row."""
    n, row = F.col("n_words"), ["_row"] * carry
    d = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.struct(*df.columns).alias(c) for c in row])
    d = d.select("doc_id", *row, "_text", words_of(F.col("_text")).alias("_w"), F.filter(F.split("_text", "\n"), lambda s: s.rlike(NOT_SPACE)).alias("_l"))
    d = d.select(
        "doc_id", *row, F.xxhash64("_text").alias("_digest"), F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    rest = [c for c in d.columns if c != "_h"]
    for step in (1, 2, 4):  # hashes of 2, 4, 8 words
        d = d.select(*rest, F.zip_with("_h", F.slice("_h", step + 1, F.size("_h")), lambda a, b: F.xxhash64(a, b)).alias("_h"))
    d = d.select(*rest, F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))).alias("_h"))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(*rest, F.when(some, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    again = F.filter("_s", lambda x, j: F.coalesce((F.get("_s", j - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get("_s", j + 1)["h"] == x["h"]), F.lit(False)))
    d = d.select(*rest, F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(again, lambda x: x["i"]))).alias("_p"))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("at"), (a["sum"] + F.least(F.lit(WINDOW), p - a["at"])).alias("sum")), lambda a: a["sum"])
    # never true, but not deterministic: keeps the optimizer from copying all of the above into a filter on the counts,
    # which would evaluate the nested arrays over and over
    barrier = F.spark_partition_id() < 0
    d = d.select(*rest, F.when(F.col("_p").isNull() | barrier, F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))


def _depleted(n_words: Column, lost: Column) -> Column:
    left = n_words - lost
    return (lost > 0) & ((left < MIN_LEFT) | (left < MIN_LEFT_SHARE * n_words))


def _with_lost(base: DataFrame, lost: DataFrame) -> DataFrame:
    """base with lost_words and lost_lines."""
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), "lost", "positions")
    both = base.join(lost, base["doc_id"].eqNullSafe(lost["_id"]) & (base["_digest"] == lost["_d"]), "left")
    return both.select(*base.columns, F.coalesce("lost", F.lit(0)).alias("lost_words"), F.coalesce("positions", F.array().cast("array<int>")).alias("lost_lines"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """One row per input row: the base counts, base_failed, lost_words, lost_lines, kept."""
    d = _with_lost(base_rules(df, id_col, text_col), removed_lines(df, id_col, text_col, host_col, **limits))
    return d.withColumn("kept", ~F.col("base_failed") & ~_depleted(F.col("n_words"), F.col("lost_words")))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", **limits) -> DataFrame:
    """df without rejected rows and without boiler-plate lines; columns as they were. The base rules need the row alone, so only texts whose ids may lose lines meet the written table of lost lines."""
    lost = written(removed_lines(df, id_col, text_col, host_col, **limits), "lost")
    touched = may_hold(lost.select(F.xxhash64("doc_id").alias("k")), "k")(F.xxhash64(F.col(id_col)))
    base = lambda rows: base_rules(rows, id_col, text_col, carry=True).filter("not base_failed")
    rest = base(df.filter(~touched)).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])

    d = _with_lost(base(df.filter(touched)), lost)
    d = d.filter(~_depleted(F.col("n_words"), F.col("lost_words")))
    some, text = F.size("lost_lines") > 0, F.col(f"_row.`{text_col}`")
    d = d.withColumn("_lines", once(F.split(text, "\n")))
    out = d.withColumn("_new", once(F.when(some, F.array_join(without(F.col("_lines"), F.col("lost_lines")), "\n")).otherwise(text)))
    put = {text_col: F.col("_new"), chars_col: F.when(some, F.length("_new").cast("long")).otherwise(F.col(f"_row.`{chars_col}`"))}
    return rest.unionByName(out.select(*[put[c].alias(c) if c in put else F.col(f"_row.`{c}`").alias(c) for c in df.columns]))
