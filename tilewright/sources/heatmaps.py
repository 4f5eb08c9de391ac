"""Heat maps as chunk rows: (keys..., cy, cx, cells: array<struct<i, v>>), i the place in the chunk; and an attributes table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunks(cells: DataFrame, keys: list[str], value: str, size: int = 1024) -> DataFrame:
    i = ((F.col("y") % size) * size + F.col("x") % size).cast("int")
    d = cells.groupBy(*keys, F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx"))
    return d.agg(F.sort_array(F.collect_list(F.struct(i.alias("i"), F.col(value).alias("v")))).alias("cells"))


def cells(chunked: DataFrame, keys: list[str], value: str, size: int = 1024) -> DataFrame:
    d = chunked.select(*keys, "cy", "cx", F.explode("cells").alias("c"))
    return d.select(*keys, (F.col("cy") * size + F.floor(F.col("c.i") / size)).alias("y"), (F.col("cx") * size + F.col("c.i") % size).alias("x"), F.col("c.v").alias(value))


def write(chunked: DataFrame, attrs: DataFrame, keys: list[str], path: str) -> None:
    """A folder per slide, so reading one slide prunes the others; attributes beside."""
    chunked.write.mode("overwrite").option("compression", "zstd").partitionBy(*keys).parquet(f"{path}/chunks")
    attrs.write.mode("overwrite").parquet(f"{path}/attrs")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/attrs")
