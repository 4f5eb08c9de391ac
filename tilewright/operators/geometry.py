"""Polygons as arrays of points. Expressions where they suffice; the clip and the rotated rectangle are Arrow batches.

A polygon is struct<exterior: array<struct<x,y>>, holes: array<array<struct<x,y>>>>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RING = "array<struct<x:double,y:double>>"
POLYGON = f"struct<exterior:{RING},holes:array<{RING}>>"


def ring(points) -> Column:
    """A literal ring."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def rectangle(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    p = lambda sx, sy: F.struct((cx + sx * w / 2.0).alias("x"), (cy + sy * h / 2.0).alias("y"))
    return F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1))


def edges(r: Column) -> Column:
    """array<struct<x1,y1,x2,y2>>: a ring's edges, the last to the first point."""
    after = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def ring_area(r: Column) -> Column:
    """Shoelace."""
    return F.abs(F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2.0


def polygon_area(p: Column) -> Column:
    return ring_area(p["exterior"]) - F.aggregate(F.transform(p["holes"], ring_area), F.lit(0.0), lambda s, a: s + a)


def bounds(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def scaled(r: Column, factor: Column) -> Column:
    return F.transform(r, lambda p: F.struct((p["x"] / factor).alias("x"), (p["y"] / factor).alias("y")))


def in_ring(r: Column, x: Column, y: Column) -> Column:
    """Crossing number."""
    crosses = F.filter(edges(r), lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crosses) % 2 == 1


def in_polygon(p: Column, x: Column, y: Column) -> Column:
    return in_ring(p["exterior"], x, y) & ~F.exists(p["holes"], lambda h: in_ring(h, x, y))


def in_bounds(r: Column, width: Column, height: Column, slack: float = 1.0) -> Column:
    b = bounds(r)
    return (b["xmin"] >= -slack) & (b["ymin"] >= -slack) & (b["xmax"] <= width + slack) & (b["ymax"] <= height + slack)


def cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> Column:
    """array<struct<cx,cy>> of the grid cells that a box touches: the key of a spatial join."""
    at = lambda v: F.floor(v / size)
    return F.flatten(F.transform(F.sequence(at(xmin), at(xmax)), lambda cx: F.transform(F.sequence(at(ymin), at(ymax)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def box_join(windows: DataFrame, polygons: DataFrame, on: list[str], size: float) -> DataFrame:
    """Pairs of windows and polygons whose boxes (xmin, ymin, xmax, ymax; pxmin, ...) overlap.

    Both sides are dealt to grid cells, joined by cell; of the cells that a pair shares only the first gives the pair,
    so nothing needs deduplicating.
    """
    w = windows.withColumn("_c", F.explode(cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)))
    p = polygons.withColumn("_c", F.explode(cells(F.col("pxmin"), F.col("pymin"), F.col("pxmax"), F.col("pymax"), size)))
    d = w.join(p, [*on, "_c"]).filter("xmin < pxmax and pxmin < xmax and ymin < pymax and pymin < ymax")
    first = (F.col("_c.cx") == F.floor(F.greatest("xmin", "pxmin") / size)) & (F.col("_c.cy") == F.floor(F.greatest("ymin", "pymin") / size))
    return d.filter(first).drop("_c")


def first_containing(points: DataFrame, polygons: DataFrame, on: list[str], size: float, order: str = "gt") -> DataFrame:
    """points (with columns x, y, point) with the first polygon, by its order, that contains each; null if none does. polygons: order, polygon."""
    box = bounds(F.col("polygon.exterior"))
    p = polygons.withColumn("_b", box)
    p = p.withColumn("_c", F.explode(cells(F.col("_b.xmin"), F.col("_b.ymin"), F.col("_b.xmax"), F.col("_b.ymax"), size))).drop("_b")
    at = points.withColumn("_c", F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")))
    hits = at.join(p, [*on, "_c"]).filter(in_polygon(F.col("polygon"), F.col("x"), F.col("y"))).groupBy(*on, "point").agg(F.min(order).alias(order))
    return points.join(hits, [*on, "point"], "left")


def clip_ring(points: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to a rectangle, side by side."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(points):
            break
        inside = keep * (points[:, axis] - bound) >= 0
        out = []
        for i in range(len(points)):
            a, b = points[i - 1], points[i]
            if inside[i] != inside[i - 1]:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(a + t * (b - a))
            if inside[i]:
                out.append(b)
        points = np.array(out).reshape(-1, 2)
    return points


def area_of(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _points(r) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in r], dtype=float).reshape(-1, 2)


@F.pandas_udf(DoubleType())
def clipped_area(polygon: pd.DataFrame, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """The area of a polygon inside a rectangle, holes left out."""
    out = []
    for e, h, *box in zip(polygon["exterior"], polygon["holes"], x0, y0, x1, y1, strict=True):
        out.append(area_of(clip_ring(_points(e), *box)) - sum(area_of(clip_ring(_points(r), *box)) for r in h))
    return pd.Series(out, dtype=float)


def area_fraction(covered: Column, window_area: Column) -> Column:
    return F.least(F.lit(1.0), covered / F.greatest(window_area, F.lit(1e-9)))


def hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain."""
    p = sorted(map(tuple, points))
    p = [q for i, q in enumerate(p) if i == 0 or q != p[i - 1]]
    if len(p) < 3:
        return np.array(p, dtype=float).reshape(-1, 2)

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), dtype=float)


def major_axis(points: np.ndarray) -> float:
    """The longer side of the smallest rectangle around the points, of any orientation; it lies along an edge of the hull."""
    h = hull(points)
    if len(h) < 2:
        return 0.0
    if len(h) == 2:
        return float(np.hypot(*(h[1] - h[0])))
    e = np.roll(h, -1, axis=0) - h
    u = e / np.hypot(e[:, 0], e[:, 1])[:, None]
    along, across = h @ u.T, h @ np.stack([-u[:, 1], u[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    best = int(np.argmin(a * b))
    return float(max(a[best], b[best]))


@F.pandas_udf(DoubleType())
def ring_axis(r: pd.Series) -> pd.Series:
    return pd.Series([major_axis(_points(x)) for x in r], dtype=float)


def scanline_fill(r: Column, y: Column) -> Column:
    """array<struct<from,to>>: the spans of a row that lie inside a ring, by even-odd crossings."""
    cross = F.array_sort(F.transform(F.filter(edges(r), lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.filter(F.transform(cross, lambda v, i: F.struct(v.alias("from"), F.get(cross, i + 1).alias("to"), (i % 2).alias("odd"))), lambda s: (s["odd"] == 0) & s["to"].isNotNull())


def rasterise(polygons: DataFrame, keys: list[str], height: Column, width: Column) -> DataFrame:
    """(keys..., y, x): the pixels whose centres lie in the column polygon: exterior filled, holes empty. Rows by scan line, then pixels of its spans."""
    d = polygons.select(*keys, "polygon", width.alias("_w"), F.explode(F.sequence(F.lit(0), height.cast("long") - 1)).alias("y"))
    spans = d.select(*keys, "y", "polygon", "_w", F.explode(scanline_fill(F.col("polygon.exterior"), F.col("y").cast("double"))).alias("s"))
    lo, hi = F.greatest(F.ceil("s.from"), F.lit(0)), F.least(F.ceil("s.to") - 1, F.col("_w") - 1)
    pixels = spans.filter(hi >= lo).select(*keys, "polygon", "y", F.explode(F.sequence(lo, hi)).alias("x"))
    return pixels.filter(~F.exists("polygon.holes", lambda h: in_ring(h, F.col("x").cast("double"), F.col("y").cast("double")))).select(*keys, "y", "x").distinct()


def combined(tumor: DataFrame, exclusion: DataFrame, keys: list[str], height: Column, width: Column) -> DataFrame:
    """Pixels of the union of the tumour polygons without those of the exclusions."""
    return rasterise(tumor, keys, height, width).join(rasterise(exclusion, keys, height, width), [*keys, "y", "x"], "left_anti")


def repaired(df: DataFrame, col: str = "ring") -> DataFrame:
    """df with rings freed of repeated points and of spikes; rings of under three points are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for r in d[col]:
                p = [tuple(q.values()) if isinstance(q, dict) else (q["x"], q["y"]) for q in r]
                changed = True
                while changed and len(p) > 2:
                    changed = False
                    for i in range(len(p)):
                        if p[i] == p[i - 1] or p[i - 2] == p[i]:
                            del p[i - 1 if p[i] == p[i - 1] else i - 1]
                            changed = True
                            break
                out.append([{"x": x, "y": y} for x, y in p] if len(p) > 2 else None)
            d = d.assign(**{col: out})
            yield d[d[col].notna()]

    return df.mapInPandas(run, df.schema)
