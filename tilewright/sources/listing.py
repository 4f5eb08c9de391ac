"""Object listings: lines of date, time, size and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(lines: DataFrame, col: str = "value") -> DataFrame:
    """(key, size): lines of four fields, of which the third is a whole number; a key may hold spaces. Others are dropped."""
    m = F.regexp_extract(col, r"^\s*\S+\s+\S+\s+(\S+)\s+(.*\S)\s*$", 1)
    k = F.regexp_extract(col, r"^\s*\S+\s+\S+\s+(\S+)\s+(.*\S)\s*$", 2)
    return lines.select(k.alias("key"), F.when(m.rlike(r"^[-+]?\d+$"), m.try_cast("long")).alias("size")).filter("size is not null and key != ''")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def to_fetch(chosen: DataFrame, present: DataFrame) -> DataFrame:
    """What isn't there yet with the same name and size."""
    return chosen.join(present.select("name", "size"), ["name", "size"], "left_anti")
