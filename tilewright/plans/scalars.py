"""Queries of scalar expressions: units, coordinates, keys, pixels, losses.

Stand-ins: parts are pyramid levels and scales, line items are patches, orders are slides, customers are patients.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, pixels, units
from ..registry import query

def DS():
    """Downsampling factors of three levels."""
    return F.array(F.lit(1.0), F.lit(1.9992175), F.lit(3.998435))


@query("P1_P2_level_coordinates", """
SELECT p_partkey, round(p_size * (CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.9992175 ELSE 3.998435 END)::DOUBLE, 5) AS x_l0,
       round(p_size / (CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.9992175 ELSE 3.998435 END)::DOUBLE, 5) AS x_level FROM part""")
def _(t):
    level = F.col("p_partkey") % 3
    return t.part.select("p_partkey", F.round(units.level_to_l0(F.col("p_size"), DS(), level), 5).alias("x_l0"), F.round(units.l0_to_level(F.col("p_size"), DS(), level), 5).alias("x_level"))


@query("P3_resolve_level", """
WITH m AS (SELECT p_partkey, p_size / 40.0::DOUBLE AS mpp FROM part),
l AS (SELECT p_partkey, mpp, i, d FROM m, (VALUES (0, 1.0::DOUBLE), (1, 1.9992175::DOUBLE), (2, 3.998435::DOUBLE)) v(i, d)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(ln(mpp * d / 0.5)), 12), i) AS n FROM l)
SELECT p_partkey, i AS level, round(mpp * d / 0.5, 6) AS residual FROM r WHERE n = 1""")
def _(t):
    best = units.resolve_level(DS(), F.col("p_size") / 40.0, 0.5)
    return t.part.select("p_partkey", best.alias("b")).select("p_partkey", "b.level", F.round("b.residual", 6).alias("residual"))


@query("P4_thumbnail_level", """
WITH l AS (SELECT p_partkey, p_size / 40.0::DOUBLE AS mpp, i, d FROM part, (VALUES (0, 1.0::DOUBLE), (1, 1.9992175::DOUBLE), (2, 3.998435::DOUBLE)) v(i, d)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(ln(mpp * d / 8.0)), 12), i) AS n FROM l)
SELECT p_partkey, i AS level FROM r WHERE n = 1""")
def _(t):
    return t.part.select("p_partkey", units.resolve_level(DS(), F.col("p_size") / 40.0, 8.0)["level"].alias("level"))


@query("P5_needs_resample", "SELECT p_partkey, abs(p_size / 25.0::DOUBLE - 1) > 0.05::DOUBLE AS needs FROM part")
def _(t):
    return t.part.select("p_partkey", units.needs_resample(F.col("p_size") / 25.0).alias("needs"))


@query("P6_P7_P8_P17_physical_units", """
SELECT p_partkey, greatest(1, round_even(p_size / 0.5::DOUBLE, 0))::BIGINT AS um_px, p_size * 0.25::DOUBLE AS px_um,
       greatest(1, round_even(p_size / 1000.0::DOUBLE * 1e6 / (2.0 * 2.0)::DOUBLE, 0))::BIGINT AS mm2_px,
       round(p_size * 0.25::DOUBLE * 0.25::DOUBLE / 1e6, 12) AS mm2 FROM part""")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", units.um_to_px(s, F.lit(0.5)).alias("um_px"), units.px_to_um(s, F.lit(0.25)).alias("px_um"), units.mm2_to_px(s / 1000.0, F.lit(2.0)).alias("mm2_px"), F.round(units.area_mm2(s, F.lit(0.25)), 12).alias("mm2"))


@query("P9_P10_P11_windows", """
SELECT p_partkey, least(greatest(p_size * 100 - 200, 0), floor((2500 - 512) * 1.9992175::DOUBLE))::BIGINT AS x0,
       (p_size * 100)::BIGINT AS xmin, round(p_size * 100 + 512 * 1.9992175::DOUBLE, 6) AS xmax FROM part""")
def _(t):
    x = F.col("p_size").cast("long") * 100
    box = units.bbox_l0(x, x, F.lit(512), F.lit(1.9992175))
    origin = units.checked_origin(x, x)
    return t.part.select("p_partkey", units.clamp(x - 200, F.lit(2500), 512, F.lit(1.9992175)).alias("x0"), origin["x0"].alias("xmin"), F.round(box["xmax"], 6).alias("xmax"))


@query("P12_P13_mpp_from_properties", """
WITH p AS (SELECT p_partkey, p_size, p_partkey % 5 AS k FROM part),
m AS (SELECT p_partkey, CASE k WHEN 0 THEN p_size / 100.0::DOUBLE WHEN 1 THEN p_size / 200.0::DOUBLE WHEN 2 THEN p_size / 400.0::DOUBLE
      WHEN 3 THEN 10000.0::DOUBLE / (p_size * 1000) ELSE 25400.0::DOUBLE / (p_size * 1000) END AS mpp FROM p)
SELECT p_partkey, round(mpp, 9) AS mpp FROM m""")
def _(t):
    s = F.col("p_size")
    k = F.col("p_partkey") % 5
    text = lambda c: c.cast("string")
    props = (
        F.when(k == 0, F.create_map(F.lit("openslide.mpp-x"), text(s / 100.0), F.lit("openslide.mpp-y"), text(s / 100.0), F.lit("aperio.MPP"), F.lit("9")))
        .when(k == 1, F.create_map(F.lit("openslide.mpp-x"), F.lit("-1"), F.lit("openslide.mpp-y"), F.lit("bad"), F.lit("aperio.MPP"), text(s / 200.0)))
        .when(k == 2, F.create_map(F.lit("tiffslide.mpp-x"), text(s / 400.0), F.lit("tiffslide.mpp-y"), text(s / 400.0), F.lit("x"), F.lit("")))
        .otherwise(F.create_map(F.lit("tiff.XResolution"), text(s * 1000), F.lit("tiff.YResolution"), text(s * 1000), F.lit("tiff.ResolutionUnit"), F.when(k == 3, "centimeter").otherwise("inch")))
    )
    d = t.part.select("p_partkey", units.resolve_mpp(props).alias("m"))
    return d.select("p_partkey", F.round(units.isotropic_mpp(F.col("m.x"), F.col("m.y")), 9).alias("mpp"))


@query("P14_P23_downsamples", """
SELECT p_partkey, round(0.5 * (4000.0::DOUBLE / (2000 + p_size) + 3000.0::DOUBLE / 1500), 6) AS second, p_size = 0 AS powers FROM part""")
def _(t):
    dim = lambda w, h: F.struct(w.cast("double").alias("w"), h.cast("double").alias("h"))
    dims = F.array(dim(F.lit(4000), F.lit(3000)), dim(F.lit(2000) + F.col("p_size"), F.lit(1500)))
    d = t.part.select("p_partkey", units.normal_downsamples(dims, F.array().cast("array<double>")).alias("d"))
    return d.select("p_partkey", F.round(F.element_at("d", 2), 6).alias("second"), units.powers_of_two(F.col("d")).alias("powers"))


@query("P15_bucket", """
SELECT CASE WHEN l_discount > 0.05 THEN 'tumor' WHEN l_discount > 0 THEN 'boundary' ELSE 'normal' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy(units.bucket(F.col("l_discount")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("P16_clinical_class", """
SELECT CASE WHEN p_size * 60 >= 2000 THEN 'macro' WHEN p_size * 60 >= 200 THEN 'micro' ELSE 'itc' END AS kind, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    return t.part.groupBy(units.clinical_class(F.col("p_size") * 60).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("P18_P24_slide_flags", """
SELECT l_orderkey AS slide_id, CASE WHEN max(l_discount) > 0.05 THEN 'tumor' ELSE 'normal' END AS slide_class,
       min(l_quantity) <= 20 AS sat_floor_bound FROM lineitem GROUP BY 1""")
def _(t):
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("slide_id")).agg(F.max("l_discount").alias("m"), F.min("l_quantity").alias("q"))
    return d.select("slide_id", F.when(F.col("m") > 0.05, "tumor").otherwise("normal").alias("slide_class"), units.floor_bound(F.col("q"), 20).alias("sat_floor_bound"))


@query("P19_P20_object_roles", """
WITH o AS (SELECT doc_id, (CASE lang WHEN 'en' THEN 'tumor' WHEN 'fr' THEN 'normal' WHEN 'de' THEN 'test' ELSE 'x' END) || '_' || doc_id ||
  (CASE doc_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.xml' WHEN 2 THEN '_mask.tif' ELSE '.svs' END) AS name FROM documents)
SELECT doc_id, CASE WHEN name LIKE 'tumor%' THEN 'tumor' WHEN name LIKE 'normal%' THEN 'normal' WHEN name LIKE 'test%' THEN 'test' ELSE 'other' END AS kind,
       doc_id % 4 IN (0, 3) AS is_slide, doc_id % 4 = 1 AS is_annotation, doc_id % 4 = 2 AS is_raster FROM o""")
def _(t):
    end = F.col("doc_id") % 4
    base = F.when(F.col("lang") == "en", "tumor").when(F.col("lang") == "fr", "normal").when(F.col("lang") == "de", "test").otherwise("x")
    name = F.concat(base, F.lit("_"), F.col("doc_id").cast("string"), F.when(end == 0, ".tif").when(end == 1, ".xml").when(end == 2, "_mask.tif").otherwise(".svs"))
    d = t.documents.select("doc_id", name.alias("name"))
    return d.select("doc_id", keys.object_kind(F.col("name")).alias("kind"), keys.is_slide(F.col("name")).alias("is_slide"), keys.is_annotation(F.col("name")).alias("is_annotation"), keys.is_raster(F.col("name")).alias("is_raster"))


@query("P21_export_bytes", "SELECT l_returnflag, (count(*) * 83456)::BIGINT AS bytes FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select("l_returnflag", units.export_bytes(F.col("n")).alias("bytes"))


@query("P22_A12_captured_area", """
SELECT l_linestatus, round(sum(l_discount * pow(512 * 0.25::DOUBLE * (1 + l_linenumber) / 1000.0::DOUBLE, 2)), 4) AS mm2 FROM lineitem GROUP BY 1""")
def _(t):
    area = units.patch_mm2(F.lit(512), F.lit(0.25), 1 + F.col("l_linenumber"))
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_discount") * area), 4).alias("mm2"))


@query("P25_single_precision_threshold", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_tax::FLOAT::DOUBLE > 0.04 GROUP BY 1")
def _(t):
    """The quotient is rounded before it meets the threshold; single precision stands for half, which Spark lacks."""
    return t.lineitem.filter(F.col("l_tax").cast("float").cast("double") > F.lit(0.04)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("F1_patient_id", "SELECT doc_id, regexp_extract('patient_' || doc_id || '_node_' || (doc_id % 5), '^(?:(patient_[0-9]+)_node_)', 1) AS patient FROM documents")
def _(t):
    slide = F.concat(F.lit("patient_"), F.col("doc_id").cast("string"), F.lit("_node_"), (F.col("doc_id") % 5).cast("string"))
    return t.documents.select("doc_id", keys.patient_id(slide, r"(patient_\d+)_node_").alias("patient"))


@query("F2_hash_split", """
WITH h AS (SELECT c_custkey, ('0x' || substr(md5('1337:' || c_custkey), 1, 8))::BIGINT % 100 AS h FROM customer)
SELECT c_custkey, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split FROM h""")
def _(t):
    return t.customer.select("c_custkey", keys.hash_split(F.col("c_custkey")).alias("split"))


@query("F3_seeded_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1337:' || c_name)) AS place FROM customer")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("c_mktsegment").orderBy(keys.shuffle_key(F.col("c_name")))
    return t.customer.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("F4_patch_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || '_' || l_partkey || '_' || l_suppkey || CASE WHEN l_linenumber > 3 THEN '_j' || l_linenumber ELSE '' END AS key FROM lineitem""")
def _(t):
    copy = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", keys.patch_key(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), copy).alias("key"))


@query("F5_F6_run_id", """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_' || substr(sha1(o_orderkey::VARCHAR), 1, 7) || CASE WHEN o_orderstatus = 'P' THEN '-dirty' ELSE '' END
       || '_' || substr(sha1('{"k":' || o_custkey || '}'), 1, 8) AS run FROM orders""")
def _(t):
    conf = keys.config_hash(F.concat(F.lit('{"k":'), F.col("o_custkey").cast("string"), F.lit("}")))
    return t.orders.select("o_orderkey", keys.run_id(F.col("o_orderdate"), F.sha1(F.col("o_orderkey").cast("string")), conf, F.col("o_orderstatus") == "P").alias("run"))


@query("F7_F9_path_parts", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?]*)', 1) || '.tif' AS path FROM pages)
SELECT page_id, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem, '.tif' AS ext, regexp_extract(path, '^(.*)/', 1) AS folder,
       substr(path, 1, length(path) - 4) || '.xml' AS sibling, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^([^0-9]*)', 1) AS prefix FROM p""")
def _(t):
    p = t.pages.select("page_id", F.concat(F.regexp_extract("url", r"^https?://([^?]*)", 1), F.lit(".tif")).alias("path"))
    c = F.col("path")
    return p.select("page_id", keys.stem(c).alias("stem"), keys.suffix(c).alias("ext"), keys.folder(c).alias("folder"), keys.with_suffix(c, ".xml").alias("sibling"), keys.name_prefix(c).alias("prefix"))


@query("F8_annotation_group", """
SELECT p_brand, CASE WHEN p_size % 4 = 2 THEN 'exclusion' WHEN p_size % 4 = 3 AND p_size % 7 = 0 THEN 'exclusion' ELSE 'tumor' END AS grp, count(*) AS n FROM part GROUP BY 1, 2""")
def _(t):
    s = F.col("p_size")
    group = F.when(s % 4 == 0, " _0 ").when(s % 4 == 1, "odd").when(s % 4 == 2, "_2").otherwise("  ")
    name = F.when(s % 7 == 0, " Exclusion").otherwise("Metastases")
    return t.part.groupBy("p_brand", keys.annotation_group(group, name).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("F10_utc_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS run_utc FROM events")
def _(t):
    return t.events.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("run_utc"))


RGB_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 37) % 256 AS r, (l_suppkey * 91) % 256 AS g, (l_orderkey * 53) % 256 AS b, l_quantity AS q FROM lineitem"


def _rgb(t):
    r, g, b = (F.col("l_partkey") * 37) % 256, (F.col("l_suppkey") * 91) % 256, (F.col("l_orderkey") * 53) % 256
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("r"), g.alias("g"), b.alias("b"), F.col("l_quantity").alias("q"))


@query("R17_composite_on_white", f"""
WITH p AS ({RGB_SQL}), c AS (SELECT r, g, least(255, q * 5) AS a FROM p)
SELECT round_even(r * a / 255.0::DOUBLE + (255.0::DOUBLE - a), 0)::INTEGER AS v, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    d = _rgb(t).select(pixels.on_white(F.col("r"), F.least(F.lit(255.0), F.col("q") * 5)).alias("v"))
    return d.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


HSV_SQL = f"""
WITH p AS ({RGB_SQL}), m AS (SELECT *, greatest(r, g, b) AS v, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM p),
a AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60.0::DOUBLE * (g - b) / d WHEN v = g THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / d
      ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / d END AS deg FROM m),
h AS (SELECT *, (round_even(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2.0, 0) % 180)::INTEGER AS h,
      (CASE WHEN v = 0 THEN 0 ELSE round_even(255.0::DOUBLE * d / v, 0) END)::INTEGER AS s,
      (255 - round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0))::INTEGER AS gray FROM a)"""


@query("R19_hsv_and_gray", HSV_SQL + " SELECT h, s, v::INTEGER AS v, gray, count(*) AS n FROM h GROUP BY 1, 2, 3, 4")
def _(t):
    d = _rgb(t).select(pixels.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x"), pixels.inverted_gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))
    return d.groupBy("x.h", "x.s", "x.v", "gray").agg(F.count(F.lit(1)).alias("n"))


@query("R21_W9_artifact_mask", HSV_SQL + """
SELECT ((s / 255.0::DOUBLE > 0.35 AND NOT (h / 180.0::DOUBLE BETWEEN 0.70 AND 0.95 OR h / 180.0::DOUBLE BETWEEN 0.0 AND 0.10)) OR v / 255.0::DOUBLE < 0.20) AS pen,
       count(*) AS n FROM h GROUP BY 1""")
def _(t):
    d = _rgb(t).select(pixels.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x"))
    return d.groupBy(pixels.artifact(F.col("x.h"), F.col("x.s"), F.col("x.v")).alias("pen")).agg(F.count(F.lit(1)).alias("n"))


@query("R25_stain_jitter")
def _(t):
    """Parameters are drawn from the slide's hash, so every run gives the same picture. Its logarithms differ in the last bit between engines, so a test checks it in NumPy."""
    unit = lambda k: F.pmod(F.xxhash64(F.col("l_orderkey"), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    d = _rgb(t)
    out = pixels.stain_jitter([F.col("r"), F.col("g"), F.col("b")], [0.95 + 0.1 * unit(k) for k in range(3)], [-0.05 + 0.1 * unit(k + 3) for k in range(3)])
    return d.select("l_orderkey", "l_linenumber", "r", "g", "b", *[c.alias(n) for c, n in zip(out, ("r2", "g2", "b2"), strict=True)])


@query("R27_normalise", f"""
WITH p AS ({RGB_SQL}) SELECT l_orderkey, l_linenumber, r, g, b, round((r / 255.0::DOUBLE - 0.485) / 0.229, 6) AS nr,
  round((g / 255.0::DOUBLE - 0.456) / 0.224, 6) AS ng, round((b / 255.0::DOUBLE - 0.406) / 0.225, 6) AS nb FROM p""")
def _(t):
    return _rgb(t).select("l_orderkey", "l_linenumber", "r", "g", "b", *[F.round(pixels.normalised(F.col(c), i), 6).alias("n" + c) for i, c in enumerate("rgb")])


TILES_SQL = "SELECT vec_id, label, (u - 1) // 8 AS y, (u - 1) % 8 AS x, e::DOUBLE AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS u FROM embeddings)"


@query("M3_losses", f"""
WITH c AS ({TILES_SQL}), p AS (SELECT *, 1 / (1 + exp(-v)) AS p, CASE WHEN (y + x) % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t,
  ln(1 + exp(-abs(v))) + greatest(-v, 0) AS soft FROM c),
i AS (SELECT vec_id, (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1) AS dice, sum((1 - t) * v + (1 + t) * soft) AS bce,
      sum((0.25 * t + 0.75 * (1 - t)) * pow(1 - (p * t + (1 - p) * (1 - t)), 2) * ((1 - t) * v + soft)) AS focal, count(*) AS n FROM p GROUP BY vec_id)
SELECT round(1 - avg(dice), 6) AS dice_loss, round(0.5 * sum(bce) / sum(n) + 0.5 * (1 - avg(dice)), 6) AS bce_dice, round(sum(focal) / sum(n), 6) AS focal FROM i""")
def _(t):
    """Dice is taken per image and then averaged; the other two are means over pixels."""
    c = tiles(t).withColumn("t", F.when((F.col("y") + F.col("x")) % 3 == 0, 1.0).otherwise(0.0)).withColumn("p", pixels.sigmoid(F.col("v")))
    i = c.groupBy("vec_id").agg(
        pixels.soft_dice(F.sum(F.col("p") * F.col("t")), F.sum("p"), F.sum("t")).alias("dice"), F.sum(pixels.bce(F.col("v"), F.col("t"), 2.0)).alias("bce"),
        F.sum(pixels.focal(F.col("v"), F.col("t"))).alias("focal"), F.count(F.lit(1)).alias("n"),
    )
    return i.agg(F.round(1 - F.avg("dice"), 6).alias("dice_loss"), F.round(0.5 * F.sum("bce") / F.sum("n") + 0.5 * (1 - F.avg("dice")), 6).alias("bce_dice"), F.round(F.sum("focal") / F.sum("n"), 6).alias("focal"))


def tiles(t):
    """Cells of 8 x 8 tiles: vec_id, label, y, x, v."""
    e = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("u", "e"))
    return e.select("vec_id", "label", F.floor(F.col("u") / 8).alias("y"), (F.col("u") % 8).cast("long").alias("x"), F.col("e").cast("double").alias("v"))


@query("M4_learning_rate", """
SELECT e AS epoch, round(CASE WHEN e < 3 THEN (e + 1) / 3.0::DOUBLE ELSE 1e-6 / 3e-4 + (1 - 1e-6 / 3e-4) * 0.5 * (1 + cos(pi() * (e - 3) / 37.0::DOUBLE)) END, 9) AS factor FROM range(40) r(e)""")
def _(t):
    return t.spark.range(40).select(F.col("id").alias("epoch"), F.round(pixels.warmup_cosine(F.col("id"), 3, 40), 9).alias("factor"))


@query("M7_M8_A19_scores", """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
m AS (SELECT vec_id, i, (e[i] + e[65 - i] + e[((i - 1) // 8) * 8 + 8 - (i - 1) % 8] + e[(7 - (i - 1) // 8) * 8 + (i - 1) % 8 + 1]) / 4 AS z FROM f, range(1, 65) r(i))
SELECT vec_id, round(avg(1 / (1 + exp(-z))), 6) AS prob_mean, round(max(1 / (1 + exp(-z))), 6) AS prob_max FROM m GROUP BY vec_id""")
def _(t):
    """Logits averaged over the tile and its three flips, then squashed; mean and maximum by tile, without leaving the row."""
    at = lambda y, x: F.get("e", (y * 8 + x).cast("int"))
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))

    def mean(i):
        y, x = F.floor(i / 8), i % 8
        return (at(y, x) + at(7 - y, 7 - x) + at(y, 7 - x) + at(7 - y, x)) / 4

    p = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: pixels.sigmoid(mean(i))).alias("p"))
    return p.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / 64, 6).alias("prob_mean"), F.round(F.array_max("p"), 6).alias("prob_max"))


@query("R24_quarter_turns_and_flips", f"""
WITH c AS ({TILES_SQL}), m AS (SELECT vec_id, v, vec_id % 4 AS t, (vec_id // 4) % 2 = 1 AS f, y, x FROM c),
r AS (SELECT vec_id, v, f, CASE t WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 7 - y ELSE 7 - x END AS a, CASE t WHEN 0 THEN x WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x ELSE y END AS b FROM m)
SELECT vec_id, CASE WHEN f THEN 7 - a ELSE a END AS y, b AS x, v FROM r""")
def _(t):
    to = pixels.rot90(F.col("y"), F.col("x"), 8, F.col("vec_id") % 4, F.floor(F.col("vec_id") / 4) % 2 == 1)
    return tiles(t).select("vec_id", to.alias("to"), "v").select("vec_id", F.col("to.u").alias("y"), F.col("to.v").alias("x"), "v")
