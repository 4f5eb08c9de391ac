"""Rasters as rows (keys..., y, x, value): downsampling, overlap-add, thresholds, morphology, components.

Row forms run on any number of executors. Components are found tile by tile and joined across tile borders, so one
slide's mask is never gathered into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import CoverageError
from ..functions import pixels

EPS, HOLE = 1e-8, 1e-6


def block_mean(cells: DataFrame, keys: list[str], value: str, factor: int) -> DataFrame:
    d = cells.groupBy(*keys, F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x"))
    return d.agg(F.avg(value).alias(value))


def overlap_add(tiles: DataFrame, keys: list[str], size: int, height: Column, width: Column, sigma: float | None = None) -> DataFrame:
    """(keys..., y, x, num, den) of tiles (hx, hy, values: array of size x size): weighted sums, which partial aggregation adds up before the shuffle. A tile that meets the far edge is anchored to it by anchored()."""
    sigma = sigma or size / 8.0
    e = tiles.select(*keys, "hx", "hy", height.alias("_h"), width.alias("_w"), F.posexplode("values").alias("i", "p"))
    v, u = F.floor(F.col("i") / size), F.col("i") % size
    e = e.select(*keys, (F.col("hy") + v).alias("y"), (F.col("hx") + u).alias("x"), "p", pixels.gaussian(u, v, size, sigma).alias("w"), "_h", "_w")
    e = e.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w")))
    return e.groupBy(*keys, "y", "x").agg(F.sum(F.col("p") * F.col("w")).alias("num"), F.sum("w").alias("den"))


def anchored(x0: Column, extent_l0: Column | float, full: Column, downsample: int, level_downsample: Column | float, cells: Column, tile: int) -> Column:
    """A tile's first cell along an axis: its origin scaled, half to even; at the far edge the map's end less the tile."""
    h = F.when(x0 + extent_l0 >= full - level_downsample, cells - tile).otherwise(F.bround(x0 / downsample))
    return F.when(cells >= tile, F.least(F.greatest(h, F.lit(0)), cells - tile)).otherwise(h).cast("long")


def finalised(sums: DataFrame) -> DataFrame:
    """The quotient, 0 where nothing was written, within 0 and 1; above 1.001 it is an error."""
    q = F.when(F.col("den") < HOLE, 0.0).otherwise(F.col("num") / (F.col("den") + EPS))
    checked = F.when(q > 1.001, F.raise_error(F.lit("a weighted mean exceeds its terms")).cast("double")).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))
    return sums.withColumn("heat", checked).drop("num", "den")


def coverage(tissue: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., uncovered, tissue, share) of the tissue cells."""
    d = tissue.select(*keys, "y", "x").join(sums.select(*keys, "y", "x", "den"), [*keys, "y", "x"], "left")
    hole = F.coalesce("den", F.lit(0.0)) < HOLE
    return d.groupBy(*keys).agg(F.count_if(hole).alias("uncovered"), F.count(F.lit(1)).alias("tissue")).withColumn("share", F.col("uncovered") / F.greatest("tissue", F.lit(1)))


def assert_covered(report: DataFrame, most: float = 1e-4) -> None:
    if bad := report.filter(F.col("share") > most).limit(5).collect():
        raise CoverageError(f"tissue without a patch: {[r.asDict() for r in bad]}")


def low_weight(sums: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """Share of the written cells with little weight."""
    return sums.filter(F.col("den") >= HOLE).groupBy(*keys).agg(F.avg((F.col("den") < least).cast("double")).alias("low"))


def nearest(cells: DataFrame, keys: list[str], value: str, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """A raster resized by the nearest source cell: each source cell gives its block of targets."""
    (h, w), (nh, nw) = old, new
    first = lambda c, a, b: F.ceil(c * F.lit(b) / a)  # noqa: E731  least i with floor(i * a / b) = c
    d = cells.withColumn("_y", F.explode(F.filter(F.sequence(first(F.col("y"), h, nh), F.greatest(first(F.col("y") + 1, h, nh), first(F.col("y"), h, nh))), lambda i: F.floor(i * F.lit(h) / nh) == F.col("y"))))
    d = d.withColumn("_x", F.explode(F.filter(F.sequence(first(F.col("x"), w, nw), F.greatest(first(F.col("x") + 1, w, nw), first(F.col("x"), w, nw))), lambda i: F.floor(i * F.lit(w) / nw) == F.col("x"))))
    return d.filter((F.col("_y") < nh) & (F.col("_x") < nw)).select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), value)


def disk(radius: int) -> Column:
    """array<struct<dy,dx>> of a disk."""
    r = max(1, int(radius))
    return F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r])


def _counted(mask: DataFrame, keys: list[str], radius: int) -> DataFrame:
    d = mask.select(*keys, "y", "x", F.explode(disk(radius)).alias("o"))
    return d.groupBy(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def dilate(mask: DataFrame, keys: list[str], radius: int, height: int | None, width: int) -> DataFrame:
    """Cells that a disk about a cell of the mask reaches, within the image; without a height it is open below."""
    d = _counted(mask, keys, radius).filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("x") < width))
    return (d if height is None else d.filter(F.col("y") < height)).drop("n")


def erode(mask: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Cells whose whole disk is in the mask; outside of the image nothing is."""
    return _counted(mask, keys, radius).filter(F.col("n") == F.size(disk(radius))).drop("n")


def opening(mask: DataFrame, keys: list[str], radius: int, height: int | None, width: int) -> DataFrame:
    return dilate(erode(mask, keys, radius), keys, radius, height, width)


def closing(mask: DataFrame, keys: list[str], radius: int, height: int | None, width: int) -> DataFrame:
    return erode(dilate(mask, keys, radius, height, width), keys, radius)


def _label(d: pd.DataFrame) -> np.ndarray:
    """Union-find over the cells of one tile; a cell's label is the place of its component's first cell in raster order."""
    order = np.lexsort((d["x"].to_numpy(), d["y"].to_numpy()))
    y, x = d["y"].to_numpy()[order], d["x"].to_numpy()[order]
    at = {c: i for i, c in enumerate(zip(y.tolist(), x.tolist(), strict=True))}
    parent = list(range(len(at)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b), i in at.items():
        for c in ((a - 1, b), (a, b - 1)):
            if c in at:
                p, q = find(at[c]), find(i)
                parent[max(p, q)] = min(p, q)
    out = np.empty(len(d), dtype=np.int64)
    out[order] = [find(i) for i in range(len(parent))]
    return out


def components(mask: DataFrame, keys: list[str], tile: int = 1024) -> DataFrame:
    """(keys..., y, x, root_y, root_x): 4-connected components; the root is the component's first cell in raster order.

    Each tile is labelled by itself, in one pass over at most tile x tile cells. Labels that touch across a tile border
    are then joined by passing the least root along until nothing changes; only border labels take part.
    """
    cells = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumn("_ty", F.floor(F.col("y") / tile)).withColumn("_tx", F.floor(F.col("x") / tile))
    schema = cells.withColumn("_l", F.lit(0).cast("long")).schema

    def run(d: pd.DataFrame) -> pd.DataFrame:
        return d.assign(_l=_label(d))

    local = cells.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)
    group = [*keys, "_ty", "_tx", "_l"]
    root = F.min(F.struct("y", "x")).over(W.partitionBy(*group))
    local = local.withColumn("_r", root).select(*keys, "y", "x", F.col("_r.y").alias("ry"), F.col("_r.x").alias("rx"))
    from ..sources.store import written

    local = written(local, "labels")
    border = lambda dy, dx: (F.col("y") % tile == tile - 1) if dy else (F.col("x") % tile == tile - 1)
    edges = None
    for dy, dx in ((1, 0), (0, 1)):
        a = local.filter(border(dy, dx)).select(*keys, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.struct("ry", "rx").alias("a"))
        e = a.join(local.select(*keys, "y", "x", F.struct("ry", "rx").alias("b")), [*keys, "y", "x"]).select(*keys, "a", "b").distinct()
        edges = e if edges is None else edges.unionByName(e).distinct()
    edges = written(edges, "borders")
    if edges.isEmpty():
        return local.select(*keys, "y", "x", F.col("ry").alias("root_y"), F.col("rx").alias("root_x"))
    both = written(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "borders")
    roots = written(both.select(*keys, "a").distinct().withColumn("root", F.col("a")), "roots")
    while True:
        near = both.join(roots.select(*keys, F.col("a").alias("b"), F.col("root").alias("other")), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("other").alias("other"))
        step = roots.join(near, [*keys, "a"]).select(*keys, "a", F.least("root", "other").alias("root"))
        # and a jump: a label takes the root of its root
        jump = step.select(*keys, F.col("a").alias("root"), F.col("root").alias("further"))
        step = written(step.join(jump, [*keys, "root"], "left").select(*keys, "a", F.least("root", "further").alias("root")), "roots")
        if step.exceptAll(roots).isEmpty():
            break
        roots = step
    d = local.withColumn("a", F.struct("ry", "rx")).join(roots, [*keys, "a"], "left")
    top = F.coalesce("root", "a")
    return d.select(*keys, "y", "x", top["ry"].alias("root_y"), top["rx"].alias("root_x"))


def _bottoms(mask: DataFrame, keys: list[str], height: int | None) -> DataFrame:
    """(keys..., _bottom) the last row of each image: without a height, the last of the mask's own."""
    if height is not None:
        return mask.select(*keys).distinct().withColumn("_bottom", F.lit(height - 1).cast("long"))
    return mask.groupBy(*keys).agg(F.max("y").cast("long").alias("_bottom"))


def background(mask: DataFrame, keys: list[str], height: int | None, width: int) -> DataFrame:
    """The cells of the image that the mask lacks."""
    every = _bottoms(mask, keys, height).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bottom")))).drop("_bottom")
    every = every.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    return every.join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")


def fill_holes(mask: DataFrame, keys: list[str], height: int | None, width: int) -> DataFrame:
    """The mask and the background components that don't reach the border; without a height it lies under the mask's last row, as what is open there is no hole in a higher image either."""
    c = components(background(mask, keys, height, width), keys)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("_bottom")) | (F.col("x") == width - 1)
    outside = c.join(_bottoms(mask, keys, height), keys).filter(edge).select(*keys, "root_y", "root_x").distinct()
    holes = c.join(outside, [*keys, "root_y", "root_x"], "left_anti").select(*keys, "y", "x")
    return mask.select(*keys, "y", "x").unionByName(holes)


def remove_small(mask: DataFrame, keys: list[str], least: int) -> DataFrame:
    c = components(mask, keys)
    big = c.groupBy(*keys, "root_y", "root_x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1, least))
    return c.join(big, [*keys, "root_y", "root_x"], "left_semi").select(*keys, "y", "x")


def otsu(values: DataFrame, keys: list[str], value: str, floor: int, min_ratio: float = 0.08) -> DataFrame:
    """(keys..., otsu, threshold, ratio, bimodal): Otsu's threshold of 8-bit values from their histogram, raised to the floor; the first of equal ones."""
    h = values.groupBy(*keys, F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto, every = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
    h = h.withColumn("c", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("v") * F.col("n")).over(upto))
    h = h.withColumn("all_n", F.sum("n").over(every)).withColumn("all_s", F.sum(F.col("v") * F.col("n")).over(every)).withColumn("all_q", F.sum(F.col("v") * F.col("v") * F.col("n")).over(every))
    w0, w1 = F.col("c") / F.col("all_n"), 1 - F.col("c") / F.col("all_n")
    gap = F.col("s") / F.col("c") - (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("c"))
    var = F.col("all_q") / F.col("all_n") - F.pow(F.col("all_s") / F.col("all_n"), F.lit(2.0))
    between = F.when(F.col("c") < F.col("all_n"), F.round(w0 * w1 * gap * gap, 9)).otherwise(0.0)
    h = h.withColumn("b", between).withColumn("var", var)
    d = h.groupBy(*keys).agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("otsu"), F.max("b").alias("b"), F.max("var").alias("var"))
    ratio = F.when(F.col("var") > 1e-9, F.col("b") / F.col("var")).otherwise(0.0)
    return d.select(*keys, "otsu", F.greatest("otsu", F.lit(floor)).alias("threshold"), ratio.alias("ratio"), (ratio >= min_ratio).alias("bimodal"))


def median_blur(images: DataFrame, keys: list[str], k: int = 7) -> DataFrame:
    """Dense images (h, w, values: array of h x w) with each value the median of its k x k neighbourhood, edges repeated; k is made odd."""
    k |= 1
    r = k // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for h, w, v in zip(d["h"], d["w"], d["values"], strict=True):
                a = np.pad(np.asarray(v, dtype=float).reshape(h, w), r, mode="edge")
                out.append(np.median(np.lib.stride_tricks.sliding_window_view(a, (k, k)), axis=(2, 3)).ravel())
            yield d.assign(values=out)

    d = images.select(*keys, "h", "w", F.col("values").cast("array<double>").alias("values"))
    return d.mapInPandas(run, d.schema)


def blur(cells: DataFrame, keys: list[str], value: str, weights: list[float]) -> DataFrame:
    """A separable weighted sum, columns then rows; weights are renewed at the edges."""
    r = len(weights) // 2
    offs = F.array(*[F.struct(F.lit(i - r).cast("long").alias("o"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    for axis, other in (("x", "y"), ("y", "x")):
        d = cells.select(*keys, other, (F.col(axis)).alias("_a"), value, F.explode(offs).alias("k"))
        s = d.groupBy(*keys, other, (F.col("_a") + F.col("k.o")).alias(axis)).agg((F.sum(F.col(value) * F.col("k.w")) / F.sum("k.w")).alias(value))
        cells = s.join(cells.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    return cells


def lesions(heat: DataFrame, keys: list[str], threshold: float, mpp: float, height: int | None, width: int, opening_px: int = 1, min_axis_um: float = 100.0, min_px: int = 0, fill: bool = True) -> DataFrame:
    """Lesions of heat maps: (keys..., lesion, area_px, area_mm2, axis_um, cy, cx, score_mean, score_max).

    Strictly above the threshold, holes filled, opened, labelled; what is shorter than min_axis_um goes; lesions count from 1
    in raster order. Keys may not have the names of the columns that come out. An axis goes through cell centres, one cell at least.
    """
    from . import geometry

    if not 0 < threshold < 1:
        raise ValueError(f"the threshold must lie between 0 and 1, not {threshold}")
    out = ["lesion", "area_px", "area_mm2", "axis_um", "cy", "cx", "score_mean", "score_max"]
    if clash := set(keys) & {*out, "y", "x", "heat", "root_y", "root_x"}:
        raise ValueError(f"keys clash with columns: {sorted(clash)}")
    mask = heat.filter(F.col("heat") > threshold).select(*keys, "y", "x")
    if fill:
        mask = fill_holes(mask, keys, height, width)
    mask = opening(mask, keys, opening_px, height, width)
    c = components(mask, keys).join(heat.select(*keys, "y", "x", "heat"), [*keys, "y", "x"], "left")
    group = [*keys, "root_y", "root_x"]
    # of a row of cells only its ends can lie on the hull
    ends = c.groupBy(*group, "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("p", F.array(*[F.struct(F.col(k).cast("double").alias("x"), F.col("y").cast("double").alias("y")) for k in "ab"]))
    axes = ends.groupBy(*group).agg(F.flatten(F.collect_list("p")).alias("ring")).select(*group, (F.greatest(geometry.ring_axis("ring"), F.lit(1.0)) * mpp).alias("axis_um"))
    h = F.coalesce("heat", F.lit(0.0))
    stats = c.groupBy(*group).agg(F.count(F.lit(1)).alias("area_px"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.avg(h).alias("score_mean"), F.max(h).alias("score_max"))
    d = stats.join(axes, group).filter((F.col("axis_um") >= min_axis_um) & (F.col("area_px") >= min_px))
    d = d.withColumn("lesion", F.dense_rank().over(W.partitionBy(*keys).orderBy("root_y", "root_x")).cast("long")).withColumn("area_mm2", F.col("area_px") * mpp * mpp / 1e6)
    return d.select(*keys, *out)
