"""Mixing sources to target weights by Sainte-Lague apportionment.

The wanted number of words is cut into equal-token blocks. Blocks go to sources by highest quotients, then each source's
blocks go to its shards the same way, so every shard gets an integer quota. Inside a shard, documents stand in a seeded
order; the quota is spread evenly over the shard's blocks from a seeded offset, each block taken 0, 1 or 2 times. What a
document contributes follows from its place alone, so no block becomes a row.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own and comes last; rows
with a null id, or that repeat one, are separate rows, and rows alike in id and text are interchangeable; with no words
at all every target is 0; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, once

#: Weights of the sources in code point order, repeating; the share of all words wanted; repeats of a source at most.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words in a shard, about; the largest block; seed of shards, orders and offsets.
SHARD_WORDS, MAX_BLOCK, SEED = 131_072, 1024, 17


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{NOT_SPACE}++")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): water filling. One row a source, so the windows are small.

    In order of cap over weight, sources fill up while the level that the rest would share stays above their own; what
    stops at its cap leaves its excess to the others by weight.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    d = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(repeats))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    d = d.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    d = d.withColumn("_all", F.sum("source_size").over(every) * share).withColumn("_ws", F.sum("_w").over(every))
    d = d.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_ws") - F.col("_used")))
    d = d.withColumn("_lambda", F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct("_capped", "_level"))).over(every)["_level"])
    return d.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_lambda"), F.col("_cap") / F.col("_w")) * F.col("_w")).alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str, most: str, out: str) -> DataFrame:
    """Seats of each key by the highest quotients vote / (2 s + 1) within its group, at most `most` each.

    A first division gives floor(vote * seats / all + 1/2); what the total then misses moves each key by no more than
    1.5 * n * vote / all + 1 seats, n being the group's keys, so only the quotients in that reach are ranked.
    """
    every = W.partitionBy(*group)
    d = votes.withColumn("_all", F.sum(vote).over(every)).withColumn("_n", F.count(F.lit(1)).over(every))
    part = F.when(F.col("_all") > 0, F.col(vote) / F.col("_all")).otherwise(0.0)
    d = d.withColumn("_first", F.floor(part * F.col(seats) + 0.5)).withColumn("_reach", F.ceil(1.5 * F.col("_n") * part) + 1)
    d = d.withColumn("_from", F.greatest(F.lit(0), F.col("_first") - F.col("_reach")))
    d = d.withColumn("_left", F.col(seats) - F.sum("_from").over(every))
    seat = d.select(*group, *key, vote, "_left", "_from", F.explode(F.sequence(F.col("_from"), F.col("_first") + F.col("_reach"))).alias("_seat"))
    best = W.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("_seat") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_seat")
    won = seat.withColumn("_place", F.row_number().over(best)).filter((F.col("_place") <= F.col("_left")) & (F.col(vote) > 0))
    won = won.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won")).toDF(*[f"_k{i}" for i in range(len(group + key))], "_won")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group + key)])
    return d.join(won, same, "left").select(*votes.columns, F.least(F.col(most), F.col("_from") + F.coalesce("_won", F.lit(0))).cast("long").alias(out))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, shard_words: int = SHARD_WORDS, max_block: int = MAX_BLOCK, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, _digest, source, size, source_size, target, block, start, nb, quota, shift, taken.

    start: the document's first word in its shard; nb, quota, shift: the shard's blocks, its quota, its seeded offset.
    """
    text = F.col(text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_digest"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    aim = targets(sizes, weights, share, repeats)
    aim = aim.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    aim = aim.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy()) / 256))).cast("long"))
    aim = aim.withColumn("block", F.coalesce("block", F.lit(1).cast("long"))).withColumn("_seats", F.round(F.sum("target").over(W.partitionBy()) / F.col("block")))
    aim = aim.withColumn("_most", F.ceil(F.col("source_size") / F.col("block") + F.col("n_shards")) * repeats)
    aim = sainte_lague(aim, ["block"], ["source"], "target", "_seats", "_most", "blocks")
    aim = aim.select(F.col("source").alias("_s"), "source_size", "target", "n_shards", "block", "blocks")

    placed = docs.join(aim, docs["source"].eqNullSafe(aim["_s"])).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_digest"), F.col("n_shards")))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").cast("double").alias("words"), F.max("block").alias("block"), F.max("blocks").alias("blocks"))
    shards = shards.withColumn("nb", F.ceil(F.col("words") / F.col("block")).cast("long")).withColumn("_most", F.col("nb") * repeats)
    quotas = sainte_lague(shards, ["source"], ["shard"], "words", "blocks", "_most", "quota")
    quotas = quotas.select(F.col("source").alias("_s2"), F.col("shard").alias("_sh"), "nb", "quota", F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.greatest("nb", F.lit(1))).alias("shift"))

    line = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "_digest"), "doc_id", "_digest").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    d = placed.join(quotas, placed["source"].eqNullSafe(quotas["_s2"]) & (placed["shard"] == quotas["_sh"]))
    upto = lambda word: taken_upto(word, F.col("block"), F.col("nb"), F.col("quota"), F.col("shift"))
    return d.select("doc_id", "_digest", "source", "size", "source_size", "target", "block", "start", "nb", "quota", "shift", (upto(F.col("start") + F.col("size")) - upto(F.col("start"))).cast("long").alias("taken"))


def times_before(b: Column, nb: Column, quota: Column, shift: Column) -> Column:
    """How often the blocks before block b are taken: the quota spread evenly, beginning at the offset."""
    share = lambda x: F.floor(x * quota / nb)
    return share(b + shift) - share(shift)


def taken_upto(word: Column, block: Column, nb: Column, quota: Column, shift: Column) -> Column:
    """Words that the mix takes of a shard's first `word` words, repeats counted."""
    b = F.floor(word / block)
    whole = times_before(b, nb, quota, shift)
    return F.when(nb > 0, whole * block + (word - b * block) * (times_before(b + 1, nb, quota, shift) - whole)).otherwise(0)


def spans(mixed: DataFrame) -> DataFrame:
    """mixed with the column spans: (first word, words, times) of the blocks of each document that the mix takes; a document's blocks are as many as its words at most."""
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    step = lambda b: times_before(b + 1, F.col("nb"), F.col("quota"), F.col("shift")) - times_before(b, F.col("nb"), F.col("quota"), F.col("shift"))
    at = lambda b: F.greatest(b * F.col("block") - F.col("start"), F.lit(0))
    row = lambda b: F.struct(at(b).cast("int").alias("at"), (F.least((b + 1) * F.col("block") - F.col("start"), F.col("size")) - at(b)).cast("int").alias("n"), step(b).cast("int").alias("times"))
    got = F.filter(F.transform(F.sequence(first, last), row), lambda x: (x["times"] > 0) & (x["n"] > 0))
    return mixed.withColumn("spans", F.when((F.col("size") > 0) & (F.col("taken") > 0), got).otherwise(F.array().cast("array<struct<at:int,n:int,times:int>>")))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix as documents: each taken document with the words of its taken blocks, white space between them kept, and once more for the blocks taken twice."""
    plan = spans(mix(df, id_col, text_col, source_col, **how)).filter("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), "spans", "size").dropDuplicates(["_id", "_d"])
    both = df.join(plan, df[id_col].eqNullSafe(plan["_id"]) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == plan["_d"]))
    both = both.withColumn("_round", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda x: x["times"])))))
    both = both.withColumn("_take", F.filter("spans", lambda x: x["times"] >= F.col("_round")))
    # pieces[2i] is the white space before word i, pieces[2i+1] the word
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"([ \\t\\n\\x0B\\f\\r]*+)({NOT_SPACE}++)"), F.lit(0))
    whole = (F.size("_take") > 0) & (F.aggregate("_take", F.lit(0), lambda a, x: a + x["n"]) == F.col("size"))
    cut = F.array_join(F.flatten(F.transform("_take", lambda x: F.slice("_pieces", x["at"] + 1, x["n"]))), "")
    both = both.withColumn("_pieces", once(F.when(~whole, pieces))).withColumn("_out", once(F.when(whole, F.col(text_col)).otherwise(cut)))
    both = both.withColumn(text_col, F.col("_out"))
    if chars_col in df.columns:
        both = both.withColumn(chars_col, F.length("_out").cast("long"))
    return both.select(*df.columns)
