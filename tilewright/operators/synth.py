"""Synthetic slides: fields of tissue and a square lesion with a hole, by hash, so every run gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys


def slide(spark: SparkSession, side: int, seed: int = 7, blob: int = 8, share: int = 30) -> DataFrame:
    """(y, x, tissue, tumor) of a square slide: a share of the blobs is tissue; the lesion fills the middle half, its hole the middle eighth. Tumour is tissue."""
    d = spark.range(side * side).select(F.floor(F.col("id") / side).alias("y"), (F.col("id") % side).alias("x"))
    part = lambda c: F.floor(F.col(c) / blob).cast("string")
    h = keys.md5_int(F.concat(F.lit(f"{seed}:"), part("y"), F.lit(":"), part("x"))) % 100
    inside = lambda a, b: F.col("y").between(a, b) & F.col("x").between(a, b)
    tumor = inside(side // 4, 3 * side // 4 - 1) & ~inside(side * 7 // 16, side * 9 // 16 - 1)
    return d.select("y", "x", ((h < share) | tumor).alias("tissue"), tumor.alias("tumor"))


def annotation_xml(rings: list[tuple[str, list[tuple[float, float]]]]) -> str:
    """An annotation file of (group, ring)."""
    out = ["<?xml version='1.0' encoding='utf-8'?>", "<ASAP_Annotations><Annotations>"]
    for i, (group, ring) in enumerate(rings):
        points = "".join(f'<Coordinate Order="{k}" X="{x}" Y="{y}"/>' for k, (x, y) in enumerate(ring))
        out.append(f'<Annotation Name="Annotation {i}" Type="Polygon" PartOfGroup="{group}"><Coordinates>{points}</Coordinates></Annotation>')
    return "\n".join([*out, "</Annotations></ASAP_Annotations>"])
