"""Polygon annotations in XML: Annotation elements with Coordinate children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import geometry

_XML = (
    "_Name string, _PartOfGroup string, _Type string, _Color string, "
    "Coordinates struct<Coordinate:array<struct<_Order:string,_X:string,_Y:string>>>, _bad string"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, grp, ring, malformed): a row per annotation of three points or more; coordinates in their order, those that don't parse left out. A malformed file gives a row that says so."""
    d = spark.read.format("xml").option("rowTag", "Annotation").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(_XML).load(path)
    return rings(d.withColumn("slide_id", keys.stem(F.col("_metadata.file_path"))))


def rings(d: DataFrame) -> DataFrame:
    c = F.coalesce("Coordinates.Coordinate", F.array().cast("array<struct<_Order:string,_X:string,_Y:string>>"))
    point = F.transform(c, lambda p, i: F.struct(F.coalesce(p["_Order"].try_cast("double"), i.cast("double")).alias("o"), p["_X"].try_cast("double").alias("x"), p["_Y"].try_cast("double").alias("y")))
    good = F.array_sort(F.filter(point, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    ring = F.transform(good, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    out = d.select("slide_id", keys.annotation_group(F.col("_PartOfGroup"), F.col("_Name")).alias("grp"), ring.alias("ring"), F.col("_bad").isNotNull().alias("malformed"))
    return out.filter((F.size("ring") >= 3) | F.col("malformed"))


def areas(annotations: DataFrame, mpp: float) -> DataFrame:
    """(slide_id, tumor_mm2, n): of disjoint tumour rings less the exclusions inside them."""
    sign = F.when(F.col("grp") == "exclusion", -1.0).otherwise(1.0)
    a = annotations.filter("not malformed").withColumn("a", sign * geometry.ring_area(F.col("ring")))
    return a.groupBy("slide_id").agg((F.sum("a") * mpp * mpp / 1e6).alias("tumor_mm2"), F.count_if(F.col("grp") == "tumor").alias("n"))
