"""Patch grids over slides, and the share of a mask under each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import units


def training_positions(extent: Column, size: int, stride: int) -> Column:
    """Positions along an axis, no far edge; a level smaller than the window still has 0."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(extent - size, F.lit(0)).cast("long"), F.lit(stride).cast("long"))


def inference_positions(extent: Column, size: int, stride: int) -> Column:
    """Positions along an axis, the far edge always among them."""
    last = F.greatest(extent - size, F.lit(0)).cast("long")
    return F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))


def grid(slides: DataFrame, keys: list[str], w: Column, h: Column, downsample: Column, size: int = 512, stride: int = 512, far_edge: bool = False) -> DataFrame:
    """(keys..., gx, gy, x0, y0): a row per window, origins in level-0 pixels, half to even; with the far edge, clamped."""
    along = inference_positions if far_edge else training_positions
    d = slides.select(*keys, w.cast("long").alias("_w"), h.cast("long").alias("_h"), downsample.cast("double").alias("_s"))
    d = d.withColumn("gy", F.explode(along(F.col("_h"), size, stride))).withColumn("gx", F.explode(along(F.col("_w"), size, stride)))
    x, y = F.bround(F.col("gx") * F.col("_s")).cast("long"), F.bround(F.col("gy") * F.col("_s")).cast("long")
    if far_edge:
        x, y = units.clamp(x, F.col("_w"), size, F.col("_s")), units.clamp(y, F.col("_h"), size, F.col("_s"))
    return d.select(*keys, "gx", "gy", x.alias("x0"), y.alias("y0"))


def chunk(y0: Column, x0: Column, span: int) -> Column:
    """The destination chunk of a position, to order or repartition by."""
    return F.struct(F.floor(y0 / span).alias("cy"), F.floor(x0 / span).alias("cx"))


def summed_area(cells: DataFrame, keys: list[str], value: str, y: str = "y", x: str = "x") -> DataFrame:
    """(keys..., y, x, sat) of a dense raster: sat is the sum over rows below y and columns below x, for y and x from 1. Two running sums."""
    across = W.partitionBy(*keys, y).orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, x).orderBy(y).rowsBetween(W.unboundedPreceding, 0)
    d = cells.select(*keys, y, x, F.sum(value).over(across).alias("_r")).select(*keys, y, x, F.sum("_r").over(down).alias("sat"))
    return d.select(*keys, (F.col(y) + 1).alias("y"), (F.col(x) + 1).alias("x"), "sat")


def window_fractions(windows: DataFrame, sat: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """windows (columns r0, c0, r1, c1 in mask cells) with frac: four look-ups each, as one join and one aggregation; 0 for an empty box.

    Both sides come from explode(), whose rows the planner does not count: left to itself it broadcasts all of sat.
    """
    clip = lambda c, top: F.least(F.greatest(F.bround(c).cast("long"), F.lit(0)), F.lit(top))
    w = windows
    for c, top in (("r0", height), ("c0", width), ("r1", height), ("c1", width)):
        w = w.withColumn(c, clip(F.col(c), top))
    corner = lambda r, c, sign: F.struct(F.col(r).alias("y"), F.col(c).alias("x"), F.lit(sign).alias("sign"))
    names = windows.columns
    look = w.withColumn("_k", F.explode(F.array(corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1)))).select(*names, F.col("_k.y").alias("y"), F.col("_k.x").alias("x"), F.col("_k.sign").alias("sign"))
    total = look.join(sat.hint("merge"), [*keys, "y", "x"], "left").groupBy(*names).agg(F.sum(F.coalesce("sat", F.lit(0)) * F.col("sign")).alias("_t"))
    area = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    return total.select(*names, F.when((F.col("r1") > F.col("r0")) & (F.col("c1") > F.col("c0")), F.col("_t") / area).otherwise(0.0).alias("frac"))


def plan(slides: DataFrame, keys: list[str], w: Column, h: Column, downsample: Column, sat: DataFrame, mask: tuple[int, int], w0: Column, h0: Column, size: int = 512, stride: int = 256, min_tissue: float = 0.02, far_edge: bool = True) -> DataFrame:
    """The grid with each window's tissue share, gated; the mask maps to level 0 by its own shape."""
    sizes = slides.select(*keys, w0.cast("double").alias("_w0"), h0.cast("double").alias("_h0"), (downsample * size).alias("_e"))
    g = grid(slides, keys, w, h, downsample, size, stride, far_edge).hint("merge").join(sizes, keys)  # explode() again
    mh, mw = mask
    sx, sy = F.col("_w0") / mw, F.col("_h0") / mh
    g = g.select(*keys, "x0", "y0", (F.col("y0") / sy).alias("r0"), (F.col("x0") / sx).alias("c0"), ((F.col("y0") + F.col("_e")) / sy).alias("r1"), ((F.col("x0") + F.col("_e")) / sx).alias("c1"))
    return window_fractions(g, sat, keys, mh, mw).filter(F.col("frac") >= min_tissue).select(*keys, "x0", "y0", F.col("frac").alias("tissue_frac"))
