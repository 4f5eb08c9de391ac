"""Grid queries. Stand-ins: suppliers are slides whose size follows from their key; a mask is a pattern over its cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from ..registry import query


def N():
    """Rows."""
    return F.count(F.lit(1))


def slides(t):
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", (k % 7 * 300 + 400).alias("w"), (k % 5 * 350 + 500).alias("h"))


SLIDES = "s AS (SELECT s_suppkey, s_suppkey % 7 * 300 + 400 AS w, s_suppkey % 5 * 350 + 500 AS h FROM supplier)"


@query("R1_training_grid", f"""
WITH {SLIDES} SELECT s_suppkey, gx::BIGINT AS gx, gy::BIGINT AS gy, round_even(gx * 1.9992175::DOUBLE, 0)::BIGINT AS x0, round_even(gy * 1.9992175::DOUBLE, 0)::BIGINT AS y0
FROM (SELECT *, unnest(range(0, greatest(w - 512, 0) + 1, 512)) AS gx FROM s) a, LATERAL (SELECT unnest(range(0, greatest(a.h - 512, 0) + 1, 512)) AS gy) b""")
def _(t):
    return grid.grid(slides(t), ["s_suppkey"], F.col("w"), F.col("h"), F.lit(1.9992175), 512, 512)


@query("R2_R33_inference_grid", f"""
WITH {SLIDES}, x AS (SELECT s_suppkey, w, h, unnest(list_distinct(range(0, w - 256 + 1, 128) || [(w - 256)::BIGINT])) AS gx FROM s),
g AS (SELECT *, unnest(list_distinct(range(0, h - 256 + 1, 128) || [(h - 256)::BIGINT])) AS gy FROM x),
c AS (SELECT s_suppkey, least(round_even(gx * 1.9992175::DOUBLE, 0), floor((w - 256) * 1.9992175::DOUBLE))::BIGINT AS x0, least(round_even(gy * 1.9992175::DOUBLE, 0), floor((h - 256) * 1.9992175::DOUBLE))::BIGINT AS y0 FROM g)
SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY y0 // 1024, x0 // 1024, y0, x0) - 1 AS place FROM c""")
def _(t):
    """With the far edge, clamped, in the order of the chunks that the windows are written to."""
    from pyspark.sql import Window as W

    g = grid.grid(slides(t), ["s_suppkey"], F.col("w"), F.col("h"), F.lit(1.9992175), 256, 128, far_edge=True)
    at = W.partitionBy("s_suppkey").orderBy(F.floor(F.col("y0") / 1024), F.floor(F.col("x0") / 1024), "y0", "x0")
    return g.select("s_suppkey", "x0", "y0", (F.row_number().over(at) - 1).cast("long").alias("place"))


MASK = "(y * 7 + x * 3 + k) % 5 < 2"


def mask(t, key: str = "s_suppkey"):
    d = t.supplier.select(key).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    return d.withColumn("v", ((F.col("y") * 7 + F.col("x") * 3 + F.col(key)) % 5 < 2).cast("long"))


@query("O6_R3_window_fraction", f"""
WITH m AS (SELECT s_suppkey AS k, y, x, ({MASK})::INT AS v FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier), range(20) a(y), range(25) b(x)),
w AS (SELECT s_suppkey AS k, r, c FROM supplier, (SELECT unnest(range(0, 18, 3)) AS r), (SELECT unnest(range(0, 24, 4)) AS c))
SELECT w.k AS s_suppkey, r::BIGINT AS r, c::BIGINT AS c, round(avg(v), 6) AS frac FROM w JOIN m ON m.k = w.k AND y >= r AND y < least(r + 5, 20) AND x >= c AND x < least(c + 6, 25) GROUP BY 1, 2, 3""")
def _(t):
    """Four look-ups in a summed-area table instead of a range join over the cells."""
    sat = grid.summed_area(mask(t), ["s_suppkey"], "v")
    w = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(15), F.lit(3))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(20), F.lit(4))))
    w = w.select("s_suppkey", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("r").alias("r0"), F.col("c").alias("c0"), (F.col("r") + 5).alias("r1"), (F.col("c") + 6).alias("c1"))
    return grid.window_fractions(w, sat, ["s_suppkey"], 20, 25).select("s_suppkey", "r", "c", F.round("frac", 6).alias("frac"))


@query("R2_W1_gated_plan", f"""
WITH {SLIDES}, m AS (SELECT s_suppkey AS k, y, x, ({MASK})::INT AS v FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier), range(20) a(y), range(25) b(x)),
x AS (SELECT s_suppkey, w, h, unnest(list_distinct(range(0, w - 256 + 1, 128) || [(w - 256)::BIGINT])) AS x0 FROM s),
g AS (SELECT *, unnest(list_distinct(range(0, h - 256 + 1, 128) || [(h - 256)::BIGINT])) AS y0 FROM x),
c AS (SELECT *, least(greatest(round_even(y0 / (h / 20.0::DOUBLE), 0), 0), 20) AS r0, least(greatest(round_even(x0 / (w / 25.0::DOUBLE), 0), 0), 25) AS c0,
  least(greatest(round_even((y0 + 256) / (h / 20.0::DOUBLE), 0), 0), 20) AS r1, least(greatest(round_even((x0 + 256) / (w / 25.0::DOUBLE), 0), 0), 25) AS c1 FROM g),
f AS (SELECT s_suppkey, x0, y0, avg(v) AS frac FROM c JOIN m ON k = s_suppkey AND y >= r0 AND y < r1 AND x >= c0 AND x < c1 GROUP BY 1, 2, 3)
SELECT s_suppkey, x0, y0, round(frac, 6) AS tissue_frac FROM f WHERE frac >= 0.4""")
def _(t):
    sat = grid.summed_area(mask(t), ["s_suppkey"], "v")
    d = grid.plan(slides(t), ["s_suppkey"], F.col("w"), F.col("h"), F.lit(1.0), sat, (20, 25), F.col("w"), F.col("h"), 256, 128, min_tissue=0.4)
    return d.select("s_suppkey", "x0", "y0", F.round("tissue_frac", 6).alias("tissue_frac"))


@query("A27_mask_area", f"""
WITH m AS (SELECT s_suppkey AS k, y, x, ({MASK})::INT AS v FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier), range(20) a(y), range(25) b(x))
SELECT k AS s_suppkey, round(avg(v), 6) AS tissue_frac, round(sum(v) * 64.0::DOUBLE / 1e6, 9) AS tissue_mm2 FROM m GROUP BY 1""")
def _(t):
    return mask(t).groupBy("s_suppkey").agg(F.round(F.avg("v"), 6).alias("tissue_frac"), F.round(F.sum("v") * 64.0 / 1e6, 9).alias("tissue_mm2"))
