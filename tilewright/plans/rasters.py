"""Raster queries. Stand-ins: embeddings are 8 x 8 score tiles of a slide (label), laid out by their rank with stride 4."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import raster
from ..registry import query
from .scalars import TILES_SQL, tiles


def N():
    """Rows."""
    return F.count(F.lit(1))


K = ["label"]


def placed(t):
    """Tiles with their first cells: twelve a row."""
    r = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    e = t.embeddings.withColumn("r", r).withColumn("values", F.transform("embedding", lambda v: pixels.sigmoid(v.cast("double") * 8)))
    return e.select("label", "vec_id", (F.floor(F.col("r") / 12) * 4).alias("hy"), (F.col("r") % 12 * 4).cast("long").alias("hx"), "values")


def sums(t):
    return raster.overlap_add(placed(t), K, 8, F.lit(1 << 20), F.lit(52))


SUMS = """e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding FROM embeddings),
c AS (SELECT label, r // 12 * 4 AS hy, r % 12 * 4 AS hx, (u - 1) // 8 AS v, (u - 1) % 8 AS u, 1 / (1 + exp(-8 * z::DOUBLE)) AS p FROM (SELECT label, r, unnest(embedding) AS z, generate_subscripts(embedding, 1) AS u FROM e)),
w AS (SELECT label, hy + v AS y, hx + u AS x, p, exp(-pow(u - 3.5, 2) / 2) * exp(-pow(v - 3.5, 2) / 2) + 1e-3 AS w FROM c),
s AS (SELECT label, y, x, sum(p * w) AS num, sum(w) AS den FROM w GROUP BY 1, 2, 3)"""


@query("R5_gaussian_window", "SELECT v, u, round(exp(-pow(u - 3.5, 2) / 2) * exp(-pow(v - 3.5, 2) / 2) + 1e-3, 9) AS w FROM range(8) a(v), range(8) b(u)")
def _(t):
    d = t.spark.range(64).select(F.floor(F.col("id") / 8).alias("v"), (F.col("id") % 8).alias("u"))
    return d.select("v", "u", F.round(pixels.gaussian(F.col("u"), F.col("v"), 8, 1.0), 9).alias("w"))


@query("R6_R8_J12_A20_overlap_add", f"WITH {SUMS} SELECT label, y, x, round(least(greatest(CASE WHEN den < 1e-6 THEN 0 ELSE num / (den + 1e-8) END, 0), 1), 6) AS heat FROM s")
def _(t):
    return raster.finalised(sums(t)).select("label", "y", "x", F.round("heat", 6).alias("heat"))


@query("R6_R7_anchoring", """
WITH p AS (SELECT p_partkey, p_size * 40 AS x0 FROM part)
SELECT p_partkey, least(greatest(CASE WHEN x0 + 128 * 1.9992175::DOUBLE >= 2100 - 1.9992175 THEN 263 - 32 ELSE round_even(x0 / 8.0::DOUBLE, 0) END, 0), 263 - 32)::BIGINT AS hx FROM p""")
def _(t):
    x0 = F.col("p_size") * 40
    return t.part.select("p_partkey", raster.anchored(x0, 128 * 1.9992175, F.lit(2100), 8, 1.9992175, F.lit(263), 32).alias("hx"))


@query("A28_Q5_coverage", f"""
WITH {SUMS}, t AS (SELECT label, y, x FROM (SELECT DISTINCT label FROM embeddings), range(30) a(y), range(54) b(x))
SELECT t.label, count(*) FILTER (coalesce(den, 0) < 1e-6) AS uncovered, count(*) AS tissue, round(count(*) FILTER (coalesce(den, 0) < 1e-6)::DOUBLE / greatest(count(*), 1), 6) AS share
FROM t LEFT JOIN s ON t.label = s.label AND t.y = s.y AND t.x = s.x GROUP BY 1""")
def _(t):
    tissue = t.embeddings.select("label").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(53))))
    return raster.coverage(tissue, sums(t), K).withColumn("share", F.round("share", 6))


@query("A29_W10_low_weight", f"WITH {SUMS} SELECT label, round(avg((den < 0.05)::INT), 6) AS low FROM s WHERE den >= 1e-6 GROUP BY 1")
def _(t):
    return raster.low_weight(sums(t), K).withColumn("low", F.round("low", 6))


@query("R4_block_mean", f"WITH c AS ({TILES_SQL}) SELECT vec_id, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM c GROUP BY 1, 2, 3")
def _(t):
    return raster.block_mean(tiles(t), ["vec_id"], "v", 2).select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query("R13_J14_nearest_resize", f"""
WITH c AS ({TILES_SQL}), n AS (SELECT y AS ny, x AS nx FROM range(5) a(y), range(13) b(x)) SELECT vec_id, ny AS y, nx AS x, v > 0 AS v FROM c JOIN n ON y = ny * 8 // 5 AND x = nx * 8 // 13""")
def _(t):
    return raster.nearest(tiles(t).withColumn("v", F.col("v") > 0), ["vec_id"], "v", (8, 8), (5, 13)).select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


def binary(t, above: float = 0.55):
    return raster.finalised(sums(t)).filter(F.col("heat") > above).select("label", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


def _binary_sql(above: float = 0.55) -> str:
    return f"{SUMS}, b AS (SELECT label, y, x FROM s WHERE num / (den + 1e-8) > {above})"


@query("R9_threshold", f"WITH {_binary_sql()} SELECT label, count(*) AS n FROM b GROUP BY 1")
def _(t):
    return binary(t).groupBy("label").agg(N().alias("n"))


DISK = "o(dy, dx) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))"


@query("R11_opening", f"""
WITH {_binary_sql(0.45)}, {DISK}, er AS (SELECT label, y + dy AS y, x + dx AS x FROM b, o GROUP BY 1, 2, 3 HAVING count(*) = 5)
SELECT DISTINCT label, y + dy AS y, x + dx AS x FROM er, o WHERE y + dy >= 0 AND x + dx BETWEEN 0 AND 51""")
def _(t):
    return raster.opening(binary(t, 0.45), K, 1, None, 52)


@query("R11_closing", f"""
WITH {_binary_sql(0.6)}, {DISK}, d AS (SELECT DISTINCT label, y + dy AS y, x + dx AS x FROM b, o WHERE y + dy >= 0 AND x + dx BETWEEN 0 AND 51)
SELECT label, y + dy AS y, x + dx AS x FROM d, o GROUP BY 1, 2, 3 HAVING count(*) = 5""")
def _(t):
    return raster.closing(binary(t, 0.6), K, 1, None, 52)


LABELS = """r AS (SELECT label, y, x, y * 1000 + x AS c FROM b),
n AS (SELECT a.label, a.c AS c, b2.c AS d FROM r a JOIN r b2 ON a.label = b2.label AND ((abs(a.y - b2.y) = 1 AND a.x = b2.x) OR (a.y = b2.y AND abs(a.x - b2.x) = 1))),
f AS (SELECT label, c, c AS root FROM r UNION SELECT n.label, n.d, f.root FROM f JOIN n ON f.label = n.label AND f.c = n.c WHERE f.root < n.d),
l AS (SELECT label, c, min(root) AS root FROM f GROUP BY 1, 2)"""


@query("R12_components", f"WITH RECURSIVE {_binary_sql(0.6)}, {LABELS} SELECT label, c // 1000 AS y, c % 1000 AS x, root // 1000 AS root_y, root % 1000 AS root_x FROM l")
def _(t):
    return raster.components(binary(t, 0.6), K, tile=16)


@query("R14_A21_A23_remove_small", f"WITH RECURSIVE {_binary_sql(0.6)}, {LABELS}, k AS (SELECT label, root, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 6) SELECT l.label, c // 1000 AS y, c % 1000 AS x FROM l JOIN k ON l.label = k.label AND l.root = k.root")
def _(t):
    return raster.remove_small(binary(t, 0.6), K, 6)


@query("R10_fill_holes", f"""
WITH RECURSIVE {_binary_sql(0.5).replace(", b AS (", ", m AS (")}, t AS (SELECT label, max(y) + 1 AS last FROM m GROUP BY 1),
g AS (SELECT label, y, x FROM (SELECT label, unnest(range(last + 1)) AS y FROM t), range(52) c(x)),
b AS (SELECT label, y, x FROM g ANTI JOIN m USING (label, y, x)), {LABELS},
q AS (SELECT DISTINCT label, root FROM l JOIN t USING (label) WHERE c // 1000 IN (0, last) OR c % 1000 IN (0, 51))
SELECT label, y, x FROM m UNION ALL SELECT label, c // 1000, c % 1000 FROM l ANTI JOIN q USING (label, root)""")
def _(t):
    return raster.fill_holes(binary(t, 0.5), K, None, 52)


@query("R16_R15_lesions")
def _(t):
    """Checked against a NumPy version in the tests: axes need rotated rectangles."""
    heat = raster.finalised(sums(t)).withColumn("y", F.col("y").cast("long")).withColumn("x", F.col("x").cast("long"))
    return raster.lesions(heat, K, 0.5, 2.0, None, 52, opening_px=1, min_axis_um=6.0)


@query("R20_A22_A23_otsu", """
WITH v AS (SELECT l_returnflag AS g, floor((l_partkey * 37) % 200 * l_quantity / 50)::BIGINT AS v FROM lineitem),
h AS (SELECT g, v, count(*) AS n FROM v GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER u AS c, sum(v * n) OVER u AS s, sum(n) OVER a AS nn, sum(v * n) OVER a AS ss, sum(v * v * n) OVER a AS q FROM h WINDOW u AS (PARTITION BY g ORDER BY v), a AS (PARTITION BY g)),
b AS (SELECT g, v, q::DOUBLE / nn - pow(ss::DOUBLE / nn, 2) AS var, CASE WHEN c < nn THEN round(c::DOUBLE / nn * (1 - c::DOUBLE / nn) * pow(s::DOUBLE / c - (ss - s)::DOUBLE / (nn - c), 2), 9) ELSE 0 END AS b FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY b DESC, v) AS k FROM b)
SELECT g AS l_returnflag, v AS otsu, greatest(v, 20)::BIGINT AS threshold, round(b / var, 6) AS ratio, b / var >= 0.08 AS bimodal FROM r WHERE k = 1""")
def _(t):
    v = t.lineitem.select("l_returnflag", F.floor((F.col("l_partkey") * 37) % 200 * F.col("l_quantity") / 50).cast("long").alias("v"))
    return raster.otsu(v, ["l_returnflag"], "v", 20).withColumn("ratio", F.round("ratio", 6)).withColumn("threshold", F.col("threshold").cast("long"))


@query("R18_median_blur")
def _(t):
    d = t.embeddings.select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))
    return raster.median_blur(d, ["vec_id"], 3)


@query("R26_blur", f"""
WITH c AS ({TILES_SQL}), k(o, w) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.5), (1, 0.25)),
h AS (SELECT vec_id, y, x + o AS x, sum(v * w) / sum(w) AS v FROM c, k WHERE x + o BETWEEN 0 AND 7 GROUP BY 1, 2, 3)
SELECT vec_id, y + o AS y, x, round(sum(v * w) / sum(w), 6) AS v FROM h, k WHERE y + o BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def _(t):
    d = raster.blur(tiles(t), ["vec_id"], "v", [0.25, 0.5, 0.25])
    return d.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query("S25_heatmap_chunks", f"""
WITH {SUMS} SELECT label, y // 16 AS cy, x // 16 AS cx, count(*) AS cells, round(max(num / (den + 1e-8)), 6) AS top FROM s GROUP BY 1, 2, 3""")
def _(t):
    """Chunk rows as they are stored: bounded arrays of cells."""
    from ..sources import heatmaps

    c = heatmaps.chunks(raster.finalised(sums(t)), K, "heat", 16)
    return c.select("label", "cy", "cx", F.size("cells").cast("long").alias("cells"), F.round(F.array_max(F.transform("cells", lambda x: x["v"])), 6).alias("top"))


@query("R22_Q4_tissue_mask")
def _(t):
    """Three synthetic thumbnails: glass alone, tissue on glass, tissue with ink and a black border. The tests hold the invariants."""
    from ..operators import tissue

    side = 48
    d = t.spark.range(3 * side * side).select((F.col("id") % 3).alias("slide"), F.floor(F.col("id") / 3 / side).alias("y"), (F.floor(F.col("id") / 3) % side).alias("x"))
    noise = F.pmod(F.xxhash64("slide", "y", "x"), F.lit(7)) - 3
    blob = (F.col("slide") > 0) & F.col("y").between(12, 30) & F.col("x").between(10, 34)
    ink = (F.col("slide") == 2) & F.col("y").between(36, 44) & F.col("x").between(20, 40)
    dark = (F.col("slide") == 2) & (F.col("x") < 4)
    channel = lambda glass, pink, green: F.when(dark, 5).when(ink, green).when(blob, pink + noise).otherwise(glass + noise)
    thumbs = d.select("slide", "y", "x", channel(243, 196, 20).alias("r"), channel(243, 138, 200).alias("g"), channel(243, 186, 60).alias("b"))
    cfg = tissue.TissueConfig(close_um=16.0, open_um=16.0, min_object_mm2=0.002)
    _, report = tissue.tissue_mask(thumbs, ["slide"], 8.0, side, side, cfg, strict=False)
    return report.select("slide", "qc_flag", F.round("pen_frac", 6).alias("pen_frac"), F.round("tissue_frac", 6).alias("tissue_frac"))
