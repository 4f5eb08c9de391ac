"""Sampling by hash: every draw follows from the seed and the row's key, never from the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys


def place(group: list[str], key: Column, seed: int) -> Column:
    """A row's place in the seeded order of its group, from 1."""
    return F.row_number().over(W.partitionBy(*group).orderBy(keys.shuffle_key(key, seed), key))


def first_per_group(df: DataFrame, group: list[str], key: Column, k: int, seed: int = 1337) -> DataFrame:
    return df.withColumn("_p", place(group, key, seed)).filter(F.col("_p") <= k).drop("_p")


def sample(df: DataFrame, key: Column, n: int, seed: int = 1337) -> DataFrame:
    """n rows: the first of the seeded order; a top-k, no sort of all."""
    return df.orderBy(keys.shuffle_key(key, seed), key).limit(n)


def proportional_cap(df: DataFrame, bucket: str, key: Column, cap: int, seed: int = 1337) -> DataFrame:
    """All rows if they are within the cap; else each class shrunk by the same fraction, tumour and normal to one row at least."""
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    frac = F.col("_n") * F.lit(float(cap)) / F.col("_all")
    keep = F.when(F.col("_all") <= cap, F.col("_n")).otherwise(F.greatest(F.when(F.col(bucket) == "boundary", 0).otherwise(1), F.floor(frac)))
    limits = sizes.crossJoin(F.broadcast(total)).select(F.col(bucket).alias("_b"), keep.alias("_k"))  # a row a class
    d = df.withColumn("_p", place([bucket], key, seed)).join(F.broadcast(limits), F.col(bucket) == F.col("_b")).filter("_p <= _k")
    return d.drop("_p", "_b", "_k")


def balanced_draw(df: DataFrame, bucket: str, key: Column, negatives: float = 3, boundary_rate: float = 0.10, hard: Column | None = None, hard_cap: float = 0.15, seed: int = 1337) -> DataFrame:
    """All positives, `negatives` normals a positive, and boundary rows for a share of the positives; with column copies.

    A pool smaller than its draw is drawn with replacement: each row floor(draw / pool) times, the first of the seeded
    order once more. Of the negatives, up to hard_cap come from the hard rows first.
    """
    n = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    sizes = n.agg(*[F.coalesce(F.sum(F.when(F.col(bucket) == b, F.col("_n"))), F.lit(0)).alias(f"_{b}") for b in ("tumor", "normal", "boundary")])
    want_neg, want_bnd = F.floor(F.col("_tumor") * float(negatives)), F.floor(F.col("_tumor") * float(boundary_rate))
    hard = F.lit(False) if hard is None else hard
    d = df.withColumn("_hard", (F.col(bucket) == "normal") & hard).withColumn("_p", place([bucket, "_hard"], key, seed)) if hard is not None else df
    d = d.crossJoin(F.broadcast(sizes)).withColumn("_hards", F.sum(F.col("_hard").cast("long")).over(W.partitionBy(bucket)))  # sizes is one row
    n_hard = F.least(F.col("_hards"), F.floor(want_neg * hard_cap))
    rest, pool = want_neg - n_hard, F.greatest(F.col("_normal") - F.col("_hards"), F.lit(1))
    times = lambda draw, pool: F.floor(draw / pool) + F.when(F.col("_p") <= draw % pool, 1).otherwise(0)
    copies = (
        F.when(F.col(bucket) == "tumor", 1)
        .when((F.col(bucket) == "normal") & F.col("_hard"), F.when(F.col("_p") <= n_hard, 1).otherwise(0))
        .when(F.col(bucket) == "normal", times(rest, pool))
        .otherwise(times(want_bnd, F.greatest(F.col("_boundary"), F.lit(1))))
    )
    return d.withColumn("copies", copies.cast("long")).filter("copies > 0").drop("_hard", "_p", "_hards", "_tumor", "_normal", "_boundary")


def epoch_length(n_pos: Column, negatives: int = 3, boundary_rate: float = 0.10) -> Column:
    return F.floor(n_pos * (1 + negatives + boundary_rate)).cast("long")


def jittered(df: DataFrame, copies: int, reach: int = 128, seed: int = 1337, x: str = "x0", y: str = "y0", key: Column | None = None) -> DataFrame:
    """Copies of each row with hash-derived offsets of up to `reach`, not below 0; column jitter counts from 1."""
    key = key if key is not None else F.concat_ws("_", x, y)
    d = df.withColumn("jitter", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    off = lambda axis: keys.md5_int(F.concat(F.lit(f"{seed}:{axis}:"), key.cast("string"), F.lit(":"), F.col("jitter").cast("string"))) % (2 * reach + 1) - reach
    dx, dy = off("x"), off("y")
    return d.withColumn("_dx", dx).withColumn("_dy", dy).withColumn(x, F.greatest(F.lit(0), F.col(x) + F.col("_dx"))).withColumn(y, F.greatest(F.lit(0), F.col(y) + F.col("_dy"))).drop("_dx", "_dy")


def interleaved_plan(objects: DataFrame, budget: int, kind: str = "kind", name: str = "name", size: str = "size", ratio: float = 1.0, seed: int = 1337) -> DataFrame:
    """Annotations, and slides of two classes in turn, `ratio` normals a tumour, up to the first that exceeds the budget.

    Which class is next depends on counts alone, so the order is a merge of ranks: tumour j comes at (j, 0), normal k
    after as many tumours as make room for it. A running sum then cuts at the first overflow.
    """
    slides = objects.filter(F.col(kind).isin("tumor", "normal"))
    d = slides.withColumn("_j", F.row_number().over(W.partitionBy(kind).orderBy(keys.shuffle_key(F.col(name), seed), name)))
    k = F.col("_j")
    after = F.when(F.lit(float(ratio)) > k - 1, 0.0).otherwise(F.floor((k - 1) / F.lit(float(ratio))) + 1.0) if ratio > 0 else F.lit(float("inf"))
    d = d.withColumn("_at", F.when(F.col(kind) == "tumor", F.col("_j").cast("double")).otherwise(after)).withColumn("_second", (F.col(kind) == "normal").cast("int"))
    order = W.orderBy("_at", "_second", "_j").rowsBetween(W.unboundedPreceding, 0)  # a cohort's objects: a few hundred rows
    used = objects.filter(F.col(kind) == "annotation").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_used"))
    d = d.withColumn("_sum", F.sum(size).over(order)).crossJoin(F.broadcast(used)).withColumn("_over", (F.col("_sum") + F.col("_used") > budget).cast("int"))
    d = d.withColumn("_gone", F.max("_over").over(order)).filter("_gone = 0")
    return objects.filter(F.col(kind) == "annotation").select(*objects.columns).unionByName(d.select(*objects.columns))


def shard_ids(slides: DataFrame, count: str, order: str, size: int = 2000) -> DataFrame:
    """slides with a shard: a shard closes after the slide that reaches its size. The sum that restarts is sequential: one row a slide, done on the cohort's list in one task."""

    def run(batches):
        import pandas as pd

        frames = list(batches)
        d = pd.concat(frames).sort_values([order]) if frames else pd.DataFrame()
        shard, held, out = 0, 0, []
        for n in d[count] if len(d) else []:
            out.append(shard)
            held += n
            if held >= size:
                shard, held = shard + 1, 0
        if len(d):
            yield d.assign(shard=out)

    kinds = slides.schema.simpleString()[len("struct<") : -1]
    return slides.coalesce(1).mapInPandas(run, ", ".join(x.replace(":", " ", 1) for x in kinds.split(",")) + ", shard bigint")
