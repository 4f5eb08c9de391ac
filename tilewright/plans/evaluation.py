"""Evaluation queries.

Stand-ins: events are detections (score value, hit if a purchase, slide user_id) and points; labels with document
lengths are truth and score; literal polygons are lesions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, metrics
from ..registry import query


def N():
    """Rows."""
    return F.count(F.lit(1))


SCORED = "s AS (SELECT documents.doc_id, n_chars / 20000.0::DOUBLE AS score, quality = 1 AS y FROM labels JOIN documents ON labels.doc_id = documents.doc_id WHERE quality IS NOT NULL)"


def scored(t):
    d = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "n_chars"), "doc_id").filter("quality is not null")
    return d.select("doc_id", (F.col("n_chars") / 20000.0).alias("score"), (F.col("quality") == 1).alias("y"))


@query("A13_J13_threshold_sweep", f"""
WITH {SCORED}, t AS (SELECT round(0.10 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(17) r(i)),
c AS (SELECT threshold, count(*) FILTER (score > threshold AND y) AS tp, count(*) FILTER (score > threshold AND NOT y) AS fp, count(*) FILTER (score <= threshold AND y) AS fn FROM s, t GROUP BY 1)
SELECT threshold, tp, fp, fn, round(2.0::DOUBLE * tp / greatest(2 * tp + fp + fn, 1), 6) AS dice, round(tp::DOUBLE / greatest(tp + fp + fn, 1), 6) AS iou,
  round(tp::DOUBLE / greatest(tp + fp, 1), 6) AS precision, round(tp::DOUBLE / greatest(tp + fn, 1), 6) AS recall FROM c""")
def _(t):
    d = metrics.threshold_sweep(scored(t), F.col("score"), F.col("y"))
    return d.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("dice", "iou", "precision", "recall")])


@query("A13_best_threshold", f"""
WITH {SCORED}, t AS (SELECT round(0.10 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(17) r(i)),
c AS (SELECT threshold, 2.0::DOUBLE * count(*) FILTER (score > threshold AND y) / greatest(2 * count(*) FILTER (score > threshold AND y) + count(*) FILTER ((score > threshold) <> y), 1) AS dice FROM s, t GROUP BY 1)
SELECT threshold, round(dice, 6) AS dice FROM c ORDER BY c.dice DESC, threshold LIMIT 1""")
def _(t):
    return metrics.best_threshold(metrics.threshold_sweep(scored(t), F.col("score"), F.col("y"))).select("threshold", F.round("dice", 6).alias("dice"))


@query("A14_class_margin", f"""
WITH {SCORED} SELECT round(avg(score) FILTER (y), 6) AS positive, round(avg(score) FILTER (NOT y), 6) AS negative, round(avg(score) FILTER (y) - avg(score) FILTER (NOT y), 6) AS margin FROM s""")
def _(t):
    p, n = F.avg(F.when(F.col("y"), F.col("score"))), F.avg(F.when(~F.col("y"), F.col("score")))
    return scored(t).agg(F.round(p, 6).alias("positive"), F.round(n, 6).alias("negative"), F.round(p - n, 6).alias("margin"))


@query("A15_A16_J15_mask_agreement", """
WITH a AS (SELECT DISTINCT user_id, hour(ts) AS h FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, hour(ts) AS h FROM events WHERE event_type = 'click'),
j AS (SELECT coalesce(a.user_id, b.user_id) AS slide, a.h IS NOT NULL AS x, b.h IS NOT NULL AS y FROM a FULL JOIN b ON a.user_id = b.user_id AND a.h = b.h)
SELECT slide, round(count(*) FILTER (x AND y)::DOUBLE / greatest(count(*), 1), 6) AS iou, round(2.0::DOUBLE * count(*) FILTER (x AND y) / greatest(count(*) FILTER (x) + count(*) FILTER (y), 1), 6) AS dice,
  round(count(*) FILTER (x AND y)::DOUBLE / greatest(count(*) FILTER (y), 1), 6) AS recall FROM j GROUP BY 1""")
def _(t):
    """Masks as cells: a full outer join by cell, then conditional counts."""
    side = lambda kind, name: t.events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("slide"), F.hour("ts").alias("h")).distinct().withColumn(name, F.lit(True))
    j = side("view", "x").join(side("click", "y"), ["slide", "h"], "outer")
    x, y = F.coalesce("x", F.lit(False)), F.coalesce("y", F.lit(False))
    both, one = F.count_if(x & y), F.lit(1)
    return j.groupBy("slide").agg(F.round(both / F.greatest(N(), one), 6).alias("iou"), F.round(2.0 * both / F.greatest(F.count_if(x) + F.count_if(y), one), 6).alias("dice"), F.round(both / F.greatest(F.count_if(y), one), 6).alias("recall"))


@query("A17_A24_slide_scores", """
SELECT user_id AS slide, max(value) AS score, count(*) FILTER (event_type <> 'purchase') AS fp FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(F.col("user_id").alias("slide")).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("score"), F.count_if(F.col("event_type") != "purchase").alias("fp"))


@query("A24_fp_on_normal_slides", """
WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS fp, max(value) < 300 AS normal FROM events GROUP BY 1)
SELECT round(coalesce(avg(fp) FILTER (normal), 0), 6) AS mean_fp, count(*) FILTER (normal) AS slides FROM s""")
def _(t):
    s = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fp"), (F.max("value") < 300).alias("normal"))
    return s.agg(F.round(F.coalesce(F.avg(F.when(F.col("normal"), F.col("fp"))), F.lit(0.0)), 6).alias("mean_fp"), F.count_if("normal").alias("slides"))


@query("A18_E4_rank_auc", f"""
WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM s)
SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def _(t):
    return metrics.rank_auc(scored(t), F.col("score"), F.col("y")).select(F.round("auc", 6).alias("auc"))


FROC = """d AS (SELECT event_id, value, event_type = 'purchase' AS hit FROM events WHERE event_type IN ('purchase', 'error')),
n AS (SELECT count(*) FILTER (hit) + 100 AS gt FROM d), u AS (SELECT count(DISTINCT user_id) AS slides FROM events),
c AS (SELECT event_id, value, sum(hit::INT) OVER w AS tp, sum((NOT hit)::INT) OVER w AS fp FROM d WINDOW w AS (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT event_id, value, tp::BIGINT AS tp, fp::BIGINT AS fp, tp::DOUBLE / gt AS sensitivity, fp::DOUBLE / slides AS fpps FROM c, n, u)"""


def _curve(t):
    d = t.events.filter(F.col("event_type").isin("purchase", "error")).select("event_id", "value", (F.col("event_type") == "purchase").alias("hit"))
    sizes = t.events.agg((F.count_if(F.col("event_type") == "purchase") + 100).alias("gt"), F.countDistinct("user_id").alias("slides"))
    return metrics.froc(d.crossJoin(F.broadcast(sizes)), "value", "hit", "event_id", F.col("gt"), F.col("slides"))  # sizes is one row


@query("O3_E2_froc_curve", f"WITH {FROC} SELECT event_id, value, tp, fp, round(sensitivity, 6) AS sensitivity, round(fpps, 6) AS fpps FROM f")
def _(t):
    return _curve(t).select("event_id", "value", "tp", "fp", F.round("sensitivity", 6).alias("sensitivity"), F.round("fpps", 6).alias("fpps"))


@query("O4_E3_sensitivity_at_points", f"""
WITH {FROC} SELECT point, round(coalesce(max(CASE WHEN fpps <= point THEN sensitivity END), 0), 6) AS sensitivity FROM f, (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0), (4.0), (8.0)) p(point) GROUP BY 1""")
def _(t):
    return metrics.sensitivity_at(_curve(t)).select("point", F.round("sensitivity", 6).alias("sensitivity"))


@query("A26_average_sensitivity", f"""
WITH {FROC}, s AS (SELECT point, coalesce(max(CASE WHEN fpps <= point THEN sensitivity END), 0) AS x FROM f, (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0), (4.0), (8.0)) p(point) GROUP BY 1)
SELECT round(avg(x), 6) AS average FROM s""")
def _(t):
    return metrics.sensitivity_at(_curve(t)).agg(F.round(F.avg("sensitivity"), 6).alias("average"))


@query("A25_E5_bootstrap_interval")
def _(t):
    """Draws follow from hashes; a test holds the interval against the normal approximation."""
    s = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fp"))
    return metrics.bootstrap_ci(s, "user_id", "fp", draws=1000)


#: Lesions that events are matched against, in the plane (user_id, value): evaluable ones in order, and an isolated cell.
LESIONS = (((10, 20), (60, 20), (60, 120), (10, 120)), ((40, 100), (120, 60), (130, 200)), ((100, 5), (140, 5), (140, 40)))
CELL = ((70, 0), (90, 0), (90, 30), (70, 30))
EDGES_SQL = "e(gt, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({g}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for g, r in enumerate([*LESIONS, CELL]) for a, b in zip(r, r[1:] + r[:1], strict=True)) + ")"
INSIDE_SQL = f"{EDGES_SQL}, i AS (SELECT event_id, gt FROM events, e WHERE (y1 > value) <> (y2 > value) AND user_id < (x2 - x1) * (value - y1) / (y2 - y1) + x1 GROUP BY event_id, gt HAVING count(*) % 2 = 1)"


def _polygons(t, rings):
    rows = [(0, g, {"exterior": [{"x": float(x), "y": float(y)} for x, y in r], "holes": []}) for g, r in enumerate(rings)]
    return t.spark.createDataFrame(rows, f"plane int, gt int, polygon {geometry.POLYGON}")


def _points(t):
    return t.events.select(F.lit(0).alias("plane"), F.col("event_id").alias("point"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), "event_type", "value")


@query("G6_J11_point_in_polygon", f"WITH {INSIDE_SQL} SELECT event_id, min(gt) AS gt FROM i WHERE gt < 3 GROUP BY 1")
def _(t):
    d = geometry.first_containing(_points(t), _polygons(t, LESIONS), ["plane"], 32.0)
    return d.filter("gt is not null").select(F.col("point").alias("event_id"), "gt")


@query("E1_O5_lesion_matching", f"""
WITH {INSIDE_SQL}, m AS (SELECT event_id, value, user_id // 10 AS slide, (SELECT min(gt) FROM i WHERE i.event_id = v.event_id AND gt < 3) AS gt,
  EXISTS (SELECT 1 FROM i WHERE i.event_id = v.event_id AND gt = 3) AS itc FROM events v),
r AS (SELECT *, row_number() OVER (PARTITION BY slide, gt ORDER BY value DESC, event_id) AS k FROM m)
SELECT event_id, slide, value, gt IS NOT NULL AS hit FROM r WHERE (gt IS NOT NULL AND k = 1) OR (gt IS NULL AND NOT itc)""")
def _(t):
    p = _points(t)
    m = geometry.first_containing(p, _polygons(t, LESIONS), ["plane"], 32.0)
    cell = geometry.first_containing(p, _polygons(t, [CELL]).withColumnRenamed("gt", "cell"), ["plane"], 32.0, "cell").select("point", F.col("cell").isNotNull().alias("on_itc"))
    m = m.join(cell, "point").withColumn("slide", F.floor(F.col("x") / 10))
    return metrics.claimed(m, "value", "point", "slide").select(F.col("point").alias("event_id"), "slide", "value", "hit")


@query("E6_attribution_guards", """
SELECT o_orderkey AS run, o_orderstatus = 'P' AS dirty, abs(o_totalprice / 1e6 - round(o_totalprice / 1e6, 2)) > 1e-9 AS threshold_mismatch FROM orders WHERE o_orderstatus = 'P' OR abs(o_totalprice / 1e6 - round(o_totalprice / 1e6, 2)) > 1e-9""")
def _(t):
    """Runs that must not be reported: of a dirty tree, or whose threshold isn't the one that the model carries."""
    tau = F.col("o_totalprice") / 1e6
    bad = F.abs(tau - F.round(tau, 2)) > 1e-9
    return t.orders.select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "P").alias("dirty"), bad.alias("threshold_mismatch")).filter("dirty or threshold_mismatch")


@query("E7_evaluation_report", f"""
WITH {FROC}, s AS (SELECT point, coalesce(max(CASE WHEN fpps <= point THEN sensitivity END), 0) AS x FROM f, (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0), (4.0), (8.0)) p(point) GROUP BY 1),
a AS (SELECT count(*) AS dets, max(tp) AS tp, max(fp) AS fp FROM f)
SELECT dets, tp, fp, round((SELECT avg(x) FROM s), 6) AS froc FROM a""")
def _(t):
    c = _curve(t)
    a = c.agg(N().alias("dets"), F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    return a.crossJoin(F.broadcast(metrics.sensitivity_at(c).agg(F.round(F.avg("sensitivity"), 6).alias("froc"))))  # one row each


@query("G3_G9_G11_P17_areas", """
SELECT p_partkey, round((p_size * 4.0::DOUBLE) * 30, 6) AS area, round(p_size * 4.0::DOUBLE * 30 / 16, 6) AS scaled_area, round(100 - p_size * 2.0::DOUBLE, 6) AS xmin, round(115.0::DOUBLE, 6) AS ymax FROM part""")
def _(t):
    s = F.col("p_size").cast("double")
    r = t.part.select("p_partkey", geometry.rectangle(F.lit(100.0), F.lit(100.0), s * 4, F.lit(30.0)).alias("r"))
    b = geometry.bounds(F.col("r"))
    return r.select("p_partkey", F.round(geometry.ring_area(F.col("r")), 6).alias("area"), F.round(geometry.ring_area(geometry.scaled(F.col("r"), F.lit(4.0))), 6).alias("scaled_area"), F.round(b["xmin"], 6).alias("xmin"), F.round(b["ymax"], 6).alias("ymax"))


@query("G5_J10_G10_window_overlap", """
WITH w AS (SELECT p_partkey, (p_partkey % 40) * 8.0::DOUBLE AS x, (p_partkey // 40 % 40) * 8.0::DOUBLE AS y FROM part),
o AS (SELECT *, greatest(least(x + 16, 200) - greatest(x, 50), 0) * greatest(least(y + 16, 180) - greatest(y, 30), 0) AS outer_,
  greatest(least(x + 16, 150) - greatest(x, 100), 0) * greatest(least(y + 16, 120) - greatest(y, 80), 0) AS hole FROM w)
SELECT p_partkey, round(least(1, (outer_ - hole) / 256.0::DOUBLE), 6) AS tumor_frac FROM o WHERE x < 200 AND x + 16 > 50 AND y < 180 AND y + 16 > 30""")
def _(t):
    """Share of each window that a polygon with a hole covers: candidates by grid cell, exact areas by clipping."""
    x, y = (F.col("p_partkey") % 40) * 8.0, (F.floor(F.col("p_partkey") / 40) % 40) * 8.0
    w = t.part.select(F.lit(0).alias("plane"), "p_partkey", x.alias("xmin"), y.alias("ymin"), (x + 16).alias("xmax"), (y + 16).alias("ymax"))
    box = lambda a, b, c, d: [{"x": p, "y": q} for p, q in ((a, b), (c, b), (c, d), (a, d))]
    p = t.spark.createDataFrame([(0, {"exterior": box(50.0, 30.0, 200.0, 180.0), "holes": [box(100.0, 80.0, 150.0, 120.0)]}, 50.0, 30.0, 200.0, 180.0)], f"plane int, polygon {geometry.POLYGON}, pxmin double, pymin double, pxmax double, pymax double")
    d = geometry.box_join(w, p, ["plane"], 64.0)
    covered = geometry.clipped_area("polygon", "xmin", "ymin", "xmax", "ymax")
    return d.select("p_partkey", F.round(geometry.area_fraction(covered, F.lit(256.0)), 6).alias("tumor_frac"))


@query("G7_G8_P16_lesion_axes", """
SELECT p_partkey, round(greatest(p_size * 10, 40) * 1.0::DOUBLE, 4) AS axis_um, greatest(p_size * 10, 40) >= 275 AS evaluable FROM part""")
def _(t):
    """Rectangles turned by 30 degrees measure what they measure unturned."""
    a, b = F.col("p_size") * 40.0, F.lit(160.0)
    c, s = 0.8660254037844387, 0.5
    r = t.part.select("p_partkey", geometry.rectangle(F.lit(0.0), F.lit(0.0), a, b).alias("r"))
    turned = F.transform("r", lambda p: F.struct((c * p["x"] - s * p["y"]).alias("x"), (s * p["x"] + c * p["y"]).alias("y")))
    d = r.select("p_partkey", F.round(geometry.ring_axis(turned) * 0.25, 4).alias("axis_um"))
    return d.withColumn("evaluable", F.col("axis_um") >= 275)


@query("G4_bounds_check", "SELECT p_partkey, p_size * 4 > 101 AS outside FROM part")
def _(t):
    r = geometry.rectangle(F.col("p_size") * 2.0, F.lit(50.0), F.col("p_size") * 4.0, F.lit(20.0))
    return t.part.select("p_partkey", (~geometry.in_bounds(r, F.lit(100.0), F.lit(100.0))).alias("outside"))


@query("R23_G2_U6_rasterise", """
WITH s AS (SELECT s_suppkey, s_suppkey % 20 + 5 AS w FROM supplier), y AS (SELECT y FROM range(40) r(y)), x AS (SELECT x FROM range(40) r(x))
SELECT s_suppkey, count(*) AS pixels FROM s, y, x WHERE x >= 2 AND x < 2 + w AND y >= 3 AND y < 13 AND NOT (x >= 5 AND x < 8 AND y >= 5 AND y < 9) AND NOT (x >= 4 AND x < 6 AND y >= 10 AND y < 12) GROUP BY 1""")
def _(t):
    """Polygons with a hole filled by scan lines, less an exclusion."""
    box = lambda x0, y0, x1, y1: F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    w = F.col("s_suppkey") % 20 + 5
    lit = lambda *v: [F.lit(float(x)) for x in v]
    poly = lambda e, h: F.struct(e.alias("exterior"), (F.array(h) if h is not None else F.array().cast("array<array<struct<x:double,y:double>>>")).alias("holes"))
    tumor = t.supplier.select("s_suppkey", poly(box(F.lit(2.0), F.lit(3.0), F.lit(2.0) + w, F.lit(13.0)), box(*lit(5, 5, 8, 9))).alias("polygon"))
    excl = t.supplier.select("s_suppkey", poly(box(*lit(4, 10, 6, 12)), None).alias("polygon"))
    return geometry.combined(tumor, excl, ["s_suppkey"], F.lit(40), F.lit(40)).groupBy("s_suppkey").agg(N().alias("pixels"))
