"""Detection and segmentation metrics as aggregates and windows. Degenerate input gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Thresholds of the sweep; false positives per slide at which sensitivity is read.
THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(17))
POINTS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


def _relation(df: DataFrame, values, name: str) -> DataFrame:
    """A few literal values as a table."""
    return df.sparkSession.createDataFrame([(float(v),) for v in values], f"{name} double")


def threshold_sweep(df: DataFrame, score: Column, truth: Column, thresholds=THRESHOLDS) -> DataFrame:
    """Confusion counts and micro Dice at each threshold, strictly above. Scores are binned by how many thresholds they pass, in one pass; the counts are then summed from above, so rows are never multiplied by thresholds."""
    passed = sum((F.when(score > t, 1).otherwise(0) for t in thresholds), F.lit(0))
    bins = df.groupBy(passed.alias("k"), truth.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    ranks = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(thresholds))], "r int, threshold double")
    c = bins.crossJoin(F.broadcast(ranks))  # at most 36 bins by 17 thresholds
    at = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    hit = F.col("k") >= F.col("r")
    d = c.groupBy("threshold").agg(at(hit & F.col("y")).alias("tp"), at(hit & ~F.col("y")).alias("fp"), at(~hit & F.col("y")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = F.lit(1)
    return d.select(
        "threshold", "tp", "fp", "fn", (2.0 * tp / F.greatest(2 * tp + fp + fn, one)).alias("dice"), (tp / F.greatest(tp + fp + fn, one)).alias("iou"),
        (tp / F.greatest(tp + fp, one)).alias("precision"), (tp / F.greatest(tp + fn, one)).alias("recall"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the best Dice, the smallest on ties."""
    return sweep.agg(F.max_by("threshold", F.struct("dice", -F.col("threshold"))).alias("threshold"), F.max("dice").alias("dice"))


def rank_auc(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """One row: the area under the curve by average ranks, null if a class is empty. Scores are grouped first, so the one global window has a row per distinct score."""
    g = df.groupBy(score.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("p"))
    below = F.coalesce(F.sum("n").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("rank", below + (F.col("n") + 1) / 2.0).agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    auc = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))
    return r.select(F.when((F.col("p") > 0) & (F.col("q") > 0), auc).alias("auc"))


def froc(detections: DataFrame, score: str, hit: str, tie: str, n_gt: Column, n_slides: Column) -> DataFrame:
    """A point per detection, by falling score: running sensitivity and false positives per slide. No truth or no slides: no points.

    Detections are the found lesions of a cohort, thousands at most, so one ordered window holds them.
    """
    w = W.orderBy(F.col(score).desc(), tie).rowsBetween(W.unboundedPreceding, 0)
    d = detections.withColumn("tp", F.sum(F.col(hit).cast("long")).over(w)).withColumn("fp", F.sum((~F.col(hit)).cast("long")).over(w))
    return d.filter((n_gt > 0) & (n_slides > 0)).select(score, tie, "tp", "fp", (F.col("tp") / n_gt).alias("sensitivity"), (F.col("fp") / n_slides).alias("fpps"))


def sensitivity_at(curve: DataFrame, points=POINTS) -> DataFrame:
    """The best sensitivity within each number of false positives per slide, 0 if there is none: one pass over the curve."""
    row = curve.agg(*[F.coalesce(F.max(F.when(F.col("fpps") <= p, F.col("sensitivity"))), F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(points)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(f"p{i}").alias("sensitivity")) for i, p in enumerate(points)])).alias("x")).select("x.point", "x.sensitivity")


def claimed(matches: DataFrame, score: str, tie: str, slide: str = "slide_id", gt: str = "gt", itc: str = "on_itc") -> DataFrame:
    """Detections of matched lesions: of the lesions on one truth the best is a hit and the rest are dropped; those on an isolated cell are dropped; the others are false positives."""
    w = W.partitionBy(slide, gt).orderBy(F.col(score).desc(), tie)
    hits = matches.filter(F.col(gt).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("hit", F.lit(True))
    rest = matches.filter(F.col(gt).isNull() & ~F.col(itc)).withColumn("hit", F.lit(False))
    return hits.unionByName(rest)


def bootstrap_ci(df: DataFrame, key: str, value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 1337) -> DataFrame:
    """One row: lo, hi of the mean under resampling of rows.

    A resample gives each row a Poisson(1) weight that follows from seed, draw and key, so it needs no index, no order
    and no second pass: each task adds its rows' weights and weighted values to each draw, and only the sums are
    shuffled. Rows are multiplied by draws inside a task and summed there. Empty input gives nulls.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    cuts, p, total = [], 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        cuts.append(total)
        p /= k
        total += p
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    d = df.select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight)
    means = d.groupBy("draw").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
