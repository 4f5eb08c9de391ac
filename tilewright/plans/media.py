"""Source and sink queries. Stand-ins: documents are objects of a listing; the reader functions run on files in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, units
from ..operators import synth
from ..registry import query
from ..schemas import GRID, PATCHES, conform, missing
from ..sources import annotations, listing
from ..sources.store import written


def N():
    """Rows."""
    return F.count(F.lit(1))


@query("S14_listing", """
SELECT 'training/' || lang || '/obj ' || doc_id || '.tif' AS key, n_chars AS size FROM documents WHERE doc_id % 7 NOT IN (0, 1)""")
def _(t):
    """Lines of date, time, size and key; of seven, one has no size that is a number and one too few fields."""
    k = F.col("doc_id") % 7
    line = F.when(k == 0, F.concat_ws(" ", F.lit("2024-01-01 10:00:00 PRE"), F.col("lang"))).when(k == 1, F.lit("2024-01-01 10:00:00 12")).otherwise(
        F.concat(F.lit("2024-01-01 10:00:00   "), F.col("n_chars").cast("string"), F.lit(" training/"), F.col("lang"), F.lit("/obj "), F.col("doc_id").cast("string"), F.lit(".tif"))
    )
    return listing.parsed(t.documents.select(line.alias("value")))


@query("S1_S2_discovery", """
SELECT doc_id, 'obj_' || doc_id AS slide_id FROM documents WHERE doc_id % 5 IN (0, 2, 4)""")
def _(t):
    end = F.element_at(F.array(*[F.lit(x) for x in (".tif", "_mask.tif", ".SVS", ".xml", ".ndpi")]), (F.col("doc_id") % 5 + 1).cast("int"))
    p = t.documents.select("doc_id", F.concat(F.lit("raw/"), F.col("lang"), F.lit("/obj_"), F.col("doc_id").cast("string"), end).alias("path"))
    return p.filter(keys.is_slide(F.col("path"))).select("doc_id", keys.stem(F.col("path")).alias("slide_id"))


@query("S16_J16_to_fetch", """
SELECT doc_id::VARCHAR AS name, n_chars AS size FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND documents.n_chars % 2 = 0)""")
def _(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"))
    have = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").filter("n_chars % 2 = 0").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"))
    return listing.to_fetch(d, have)


@query("S17_S28_manifest", "SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 16) AS short, strlen(text)::BIGINT AS length FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha1("text"), 1, 16).alias("short"), F.octet_length("text").cast("long").alias("length"))


@query("S9_S10_annotations", """
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'exclusion' ELSE 'tumor' END AS grp, 3 + (p_size % 2) AS points, round(CASE WHEN p_size % 2 = 0 THEN p_size * 5.0::DOUBLE ELSE p_size * 10.0::DOUBLE END, 6) AS area FROM part""")
def _(t):
    """Coordinates come out of order, one of them unparsable; the ring is put in order and measured."""
    s = F.col("p_size").cast("double")
    c = lambda o, x, y: F.struct(F.lit(str(o)).alias("_Order"), x.cast("string").alias("_X"), y.cast("string").alias("_Y"))
    three = F.array(c(2, s, F.lit(10.0)), c(0, F.lit(0.0), F.lit(0.0)), c(9, F.lit("x"), F.lit(1)), c(1, s, F.lit(0.0)))
    four = F.array(c(3, F.lit(0.0), F.lit(10.0)), c(2, s, F.lit(10.0)), c(0, F.lit(0.0), F.lit(0.0)), c(9, F.lit("x"), F.lit(1)), c(1, s, F.lit(0.0)))
    coords = F.struct(F.when(F.col("p_size") % 2 == 0, three).otherwise(four).alias("Coordinate"))
    group = F.element_at(F.array(F.lit("_0"), F.lit("odd"), F.lit("_2")), (F.col("p_size") % 3 + 1).cast("int"))
    d = t.part.select(F.col("p_partkey").alias("slide_id"), group.alias("_PartOfGroup"), F.lit("").alias("_Name"), coords.alias("Coordinates"), F.lit(None).cast("string").alias("_bad"))
    from ..operators import geometry

    return annotations.rings(d).select(F.col("slide_id").alias("p_partkey"), "grp", F.size("ring").alias("points"), F.round(geometry.ring_area(F.col("ring")), 6).alias("area"))


@query("S11_philips_spacing", """
SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 0.25::DOUBLE WHEN p_size % 3 = 1 AND p_size > 1 THEN p_size / 100.0::DOUBLE END, 9) AS um FROM part""")
def _(t):
    """The whole-slide image's own spacing, else the finest, else none within reason."""
    d = F.lit('<DataObject ObjectType="DPUfsImport"><Attribute Name="S"><Array>')
    image = lambda kind, mm: F.concat(F.lit(f'<DataObject ObjectType="DPScannedImage"><Attribute Name="PIM_DP_IMAGE_TYPE">{kind}</Attribute><Attribute Name="DICOM_PIXEL_SPACING">"'), mm, F.lit('" "'), mm, F.lit('"</Attribute></DataObject>'))
    end = F.lit("</Array></Attribute></DataObject>")
    mm = F.format_string("%.6f", F.col("p_size") / 100000.0)
    x = F.when(F.col("p_size") % 3 == 0, F.concat(d, image("MACROIMAGE", F.lit("0.0001")), image("WSI", F.lit("0.00025")), end)).when(F.col("p_size") % 3 == 1, F.concat(d, image("LABELIMAGE", F.lit("0.009")), image("MACROIMAGE", mm), end)).otherwise(F.concat(d, image("WSI", F.lit("5")), end))
    return t.part.select("p_partkey", F.round(units.philips_mpp(x), 9).alias("um"))


@query("S12_S21_W5_index_round_trip", """
SELECT split, count(*) AS n, round(sum(tumor_frac::DOUBLE), 4) AS tumor FROM (SELECT l_returnflag AS split, l_discount::FLOAT AS tumor_frac FROM lineitem) GROUP BY 1""")
def _(t):
    """The patch index conformed to its schema, written, read back and summed."""
    raw = t.lineitem.select(
        F.col("l_orderkey").alias("slide_id"), F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("y0"), F.lit(1).alias("level"), F.lit(512).alias("size"),
        (F.col("l_quantity") / 50).alias("tissue_frac"), F.col("l_discount").alias("tumor_frac"), F.col("l_returnflag").alias("split"),
    )
    assert not missing(raw, PATCHES) and missing(raw, GRID)
    d = written(conform(raw, PATCHES), "patches")
    return d.groupBy("split").agg(N().alias("n"), F.round(F.sum(F.col("tumor_frac").cast("double")), 4).alias("tumor"))


@query("S23_S24_json_rows", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def _(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("line"))


@query("S29_synthetic_slide", """
WITH c AS (SELECT y, x, ('0x' || substr(md5('7:' || (y // 8) || ':' || (x // 8)), 1, 8))::BIGINT % 100 AS h FROM range(64) a(y), range(64) b(x)),
t AS (SELECT y, x, h < 30 AS tissue, y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 47 AND NOT (y BETWEEN 28 AND 35 AND x BETWEEN 28 AND 35) AS tumor FROM c)
SELECT y // 16 AS y, x // 16 AS x, count(*) FILTER (tissue OR tumor) AS tissue, count(*) FILTER (tumor) AS tumor FROM t GROUP BY 1, 2""")
def _(t):
    d = synth.slide(t.spark, 64, seed=7)
    return d.groupBy(F.floor(F.col("y") / 16).alias("y"), F.floor(F.col("x") / 16).alias("x")).agg(F.count_if("tissue").alias("tissue"), F.count_if("tumor").alias("tumor"))


@query("X1_time_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def _(t):
    """An extension: tumbling windows over events, the same plan in batch and as a stream."""
    from ..streaming import windows

    return windows.tumbling(t.events, "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))
