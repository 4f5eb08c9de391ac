"""Splits of patients, and the checks that they are sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys


def stratified_split(patients: DataFrame, patient: str = "patient", cls: str = "cls", seed: int = 1337, bounds: tuple[int, int] = (70, 85)) -> DataFrame:
    """patients with a split: ranked by hash within their class and cut at the bounds, half to even; a class of three or more has every split."""
    lo, hi = bounds
    order = W.partitionBy(cls).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(cls), F.lit(":"), F.col(patient).cast("string"))), patient)
    d = patients.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(cls)))
    train, val = F.bround(F.col("_n") * lo / 100.0), F.bround(F.col("_n") * (hi - lo) / 100.0)
    many = F.col("_n") >= 3
    val = F.when(many, F.greatest(val, F.lit(1))).otherwise(val)
    train = F.when(many, F.greatest(F.least(train, F.col("_n") - val - 1), F.lit(1))).otherwise(train)
    d = d.withColumn("split", F.when(F.col("_i") < train, "train").when(F.col("_i") < train + val, "val").otherwise("test"))
    return d.drop("_i", "_n")


def leaks(patches: DataFrame, slide: str = "slide_id", split: str = "split") -> DataFrame:
    """Slides in more than one split, with how many."""
    return patches.groupBy(slide).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def split_problems(patches: DataFrame, slide: str = "slide_id", split: str = "split", frac: str = "tumor_frac", threshold: float = 0.05, names=("train", "val", "test"), least: int = 3) -> DataFrame:
    """One row: all that makes the splits unusable, as an array of texts. One aggregate over the patches."""
    counts = []
    for s in names:
        of = F.col(split) == s
        counts += [F.countDistinct(F.when(of, F.col(slide))).alias(f"{s}_slides"), F.count_if(of & (F.col(frac) > threshold)).alias(f"{s}_tumor")]
    d = patches.agg(*counts)
    found = []
    for s in names:
        slides, tumor = F.col(f"{s}_slides"), F.col(f"{s}_tumor")
        found += [
            F.when(slides == 0, F.lit(f"{s}: no slides")),
            F.when((slides > 0) & (slides < least), F.concat(F.lit(f"{s}: only "), slides.cast("string"), F.lit(" slides"))),
            F.when((slides > 0) & (tumor == 0), F.lit(f"{s}: no tumor patches")),
        ]
    return d.select(F.array_compact(F.array(*found)).alias("problems"))


def assign(patients: DataFrame, strategy: str, patient: str = "patient", cls: str = "cls", seed: int = 1337) -> DataFrame:
    if strategy == "hash":
        return patients.withColumn("split", keys.hash_split(F.col(patient), seed))
    if strategy == "stratified":
        return stratified_split(patients, patient, cls, seed)
    raise ValueError(f"unknown split strategy {strategy!r}")
