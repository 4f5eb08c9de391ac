r"""Chat formatting by quotation linking.

A line's quote level is the number of `>` marks at its front. Consecutive lines of one level form a passage. Quoted
passages are normalised (lower case, single spaces) and hashed, and joined to the messages that said them first: to whole
bodies, to the lines between two quotes, to paragraphs, and to runs of any lines, among the earlier turns of the same
conversation. Runs are only made where a line is the first of a quoted passage, and as long as that passage. A message answers the
latest message it quotes, else the one before it. Conversations come out in reply order without their quotes. Everything
is DataFrame expressions.

A quote of level n repeats words that level n-1 quoted before; the first message that said them outside of a quote is
the original, so each level links to its own author.

Conversations of any size: the join is by conversation and hash, positions come from counts per block of turns, and the
output is a row a message, so no conversation is ever gathered; conversations() gathers blocks of at most BLOCK turns.

Defined results: a null text is an empty message; a quote with no original stays unlinked, and is removed all the same;
quotes of empty lines link to nothing; rows with a null conv_id or turn are messages that link to nothing and answer
nothing, at position null; rows that repeat conv_id and turn are ordered by role and text, those alike in all share a
position's order arbitrarily; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE

MARKS = r"^((?:[ \t]*>)+)"
#: Turns in a block, for positions and for gathered conversations.
BLOCK = 512


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with lines: array of (level, text), the marks and one space after them taken off."""
    level = lambda s: F.length(F.regexp_replace(F.regexp_extract(s, MARKS, 1), r"[^>]", ""))
    return messages.withColumn("lines", F.transform(F.split("text", "\n"), lambda s: F.struct(level(s).alias("level"), F.regexp_replace(s, MARKS + " ?", "").alias("text"))))


def _passages(lines: Column, breaks) -> Column:
    """Runs of lines: (level, text), a new one wherever breaks(line, line before) holds."""
    start = F.array().cast("array<struct<level:int,text:string,last:string>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        new = F.struct(x["level"].alias("level"), x["text"].alias("text"), x["text"].alias("last"))
        longer = F.struct(x["level"].alias("level"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"), x["text"].alias("last"))
        return F.when((F.size(done) == 0) | breaks(x, last), F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    return F.aggregate(lines, start, step)


def _worded(lines: Column) -> Column:
    """The lines that have words, normalised."""
    return F.filter(F.transform(lines, normal), lambda s: s != "")


def quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, first, n): the quoted passages of parsed messages, normalised, with the hash of the first line and the number of lines that have words."""
    runs = F.filter(_passages(F.col("lines"), lambda x, last: x["level"] != last["level"]), lambda p: p["level"] > 0)
    q = messages.filter(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "turn", F.explode(runs).alias("p"))
    q = q.select("conv_id", "turn", "p.level", normal(F.col("p.text")).alias("passage"), _worded(F.split("p.text", "\n")).alias("_l")).filter("passage != ''")
    return q.select("conv_id", "turn", "level", "passage", F.xxhash64(F.get("_l", F.lit(0))).alias("first"), F.size("_l").alias("n"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, said): what parsed messages say themselves: whole bodies, what stands between quotes, paragraphs and lines, normalised, each once."""
    own = F.filter("lines", lambda x: x["level"] == 0)
    body = F.array_join(F.transform(own, lambda x: x["text"]), "\n")
    between = F.transform(F.filter(_passages(F.col("lines"), lambda x, last: x["level"] != last["level"]), lambda p: p["level"] == 0), lambda p: p["text"])
    between = F.when(F.exists("lines", lambda x: x["level"] > 0), between).otherwise(F.array().cast("array<string>"))
    m = messages.select("conv_id", "turn", body.alias("body"), between.alias("between"))
    said = F.concat(F.array("body"), F.col("between"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    return m.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(said, normal))).alias("said")).filter("said != ''")


def runs(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, said): runs of a message's own lines, in order, that begin like a quoted passage of several lines and have as many."""
    own = _worded(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]))
    m = messages.select("conv_id", "turn", own.alias("own")).filter(F.size("own") > 1)
    starts = m.select("conv_id", "turn", F.posexplode(F.transform("own", lambda s: F.xxhash64(s))).alias("pos", "first"))
    wanted = quoted.filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("first").alias("_f"), "n").distinct()
    at = starts.join(wanted, (F.col("conv_id") == F.col("_c")) & (F.col("first") == F.col("_f")))
    at = at.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.collect_set(F.struct("pos", "n")).alias("at"))
    m = m.join(at, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))).select("conv_id", "turn", "own", F.explode("at").alias("x"))
    m = m.filter(F.col("x.pos") + F.col("x.n") <= F.size("own"))
    return m.select("conv_id", "turn", F.array_join(F.slice("own", F.col("x.pos") + 1, F.col("x.n")), " ").alias("said"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, original): the first earlier turn that said each quoted passage, null if none did.

    Joined by hash within the conversation and then by the words themselves. What is joined are first turns, one a
    passage, so a line that every message says is one row.
    """
    q = quotes(messages).withColumn("h", F.xxhash64("passage"))
    first = originals(messages).unionByName(runs(messages, q)).groupBy("conv_id", F.xxhash64("said").alias("h"), F.col("said")).agg(F.min("turn").alias("original"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), "said", "original")
    same = (q["conv_id"] == first["_c"]) & (q["h"] == first["_h"]) & (q["passage"] == first["said"]) & (first["original"] < q["turn"])
    return q.join(first, same, "left").select("conv_id", "turn", "level", "passage", "original")


def linked(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, position, turn, role, reply_to, n_quotes, n_linked, max_level, originals, text (without quotes)."""
    m = parsed(df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    per = links(m).distinct().groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"), F.max("level").alias("max_level"), F.max("original").alias("latest"), F.sort_array(F.collect_set("original")).alias("originals"))
    per = per.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "n_quotes", "n_linked", "max_level", "latest", "originals")

    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    clean = F.when(F.exists("lines", lambda x: x["level"] > 0), F.regexp_replace(own, f"^{SPACE}+|{SPACE}+$", "")).otherwise(F.col("text"))
    m = m.select("conv_id", "turn", "role", clean.alias("text"), F.floor(F.col("turn") / BLOCK).alias("block"))
    # turns before each block, and the last turn there: rows are blocks, not messages
    blocks = m.filter("conv_id is not null and turn is not null").groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("top"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_bc"), F.col("block").alias("_bb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.max("top").over(before).alias("_top"))
    line = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    m = m.withColumn("_at", F.row_number().over(line)).withColumn("_prev", F.max("turn").over(W.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)))
    m = m.join(blocks, (m["conv_id"] == blocks["_bc"]) & (m["block"] == blocks["_bb"]), "left")
    m = m.join(per, (m["conv_id"] == per["_c"]) & (m["turn"] == per["_t"]), "left")
    real = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return m.select(
        "conv_id", F.when(real, F.col("_before") + F.col("_at") - 1).cast("long").alias("position"), "turn", "role", F.when(real, F.coalesce("latest", "_prev", "_top")).alias("reply_to"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("originals", F.array().cast("array<bigint>")).alias("originals"), "text",
    )


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, messages) of linked(): reply order, since each message answers an earlier turn, in parts of at most `block` messages."""
    one = F.struct("position", "turn", "role", "reply_to", "text")
    return messages.filter("position is not null").groupBy("conv_id", F.floor(F.col("position") / block).alias("part")).agg(F.sort_array(F.collect_list(one)).alias("messages"))


ORACLE = r"""
WITH l AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations),
p AS (SELECT *, length(regexp_replace(regexp_extract(s, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
             regexp_replace(s, '^((?:[ \t]*>)+) ?', '') AS c FROM l),
m AS (SELECT conv_id, turn, any_value(role) AS role, any_value(t) AS t, max(level) AS max_level,
             coalesce(string_agg(CASE WHEN level = 0 THEN c END, chr(10) ORDER BY i), '') AS body FROM p GROUP BY conv_id, turn),
q0 AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM p WHERE level > 0),
q AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(string_agg(c, chr(10) ORDER BY i)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS passage
      FROM q0 GROUP BY conv_id, turn, level, run),
o AS (SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n[ \t]*\n') || string_split(body, chr(10))) AS x FROM m),
f AS (SELECT conv_id, trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS said, min(turn) AS original FROM o GROUP BY 1, 2),
k AS (SELECT DISTINCT q.conv_id, q.turn, level, passage, original FROM q LEFT JOIN f
      ON q.conv_id = f.conv_id AND q.passage = f.said AND f.original < q.turn WHERE passage <> ''),
a AS (SELECT conv_id, turn, count(*) AS n_quotes, count(original) AS n_linked, max(original) AS latest FROM k GROUP BY 1, 2)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) - 1 AS position, m.turn, m.role,
       coalesce(a.latest, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS reply_to,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
       sha256(CASE WHEN max_level = 0 THEN t ELSE regexp_replace(body, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') END) AS text_sha256
FROM m LEFT JOIN a ON m.conv_id = a.conv_id AND m.turn = a.turn
"""
