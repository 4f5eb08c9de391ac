"""Files as rows: discovery, digests, manifests, and the engine's sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..schemas import FAILED, MANIFEST, PATCHES, SLIDES, conform


def files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder; select only what is needed, content is then not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(folder)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the slide images, masks and tissue rasters left out."""
    d = files(spark, folder, "*.{tif,tiff,svs,ndpi,TIF,TIFF,SVS,NDPI}").select("path", "length")
    return d.filter(keys.is_slide(F.col("path"))).withColumn("slide_id", keys.stem(F.col("path")))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, sha1_16, length: the manifest of a folder."""
    d = files(spark, folder).select("path", "length", "content")
    return d.select("path", "length", F.sha2("content", 256).alias("sha256"), F.substring(F.sha1("content"), 1, 16).alias("sha1_16"))


def row_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of a table that doesn't depend on the order of its rows."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.lower(F.hex(F.bit_xor(h))).alias("hash"), F.count(F.lit(1)).alias("n"))


def write_patches(df: DataFrame, path: str) -> None:
    """The patch index, a folder per split, so a split's scan prunes the rest."""
    conform(df, PATCHES).write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), PATCHES)


def write_slides(df: DataFrame, path: str) -> None:
    conform(df, SLIDES).write.mode("overwrite").parquet(path)


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), SLIDES)


def write_failures(df: DataFrame, path: str) -> None:
    """Overwrites, so a list of an earlier run never stays."""
    conform(df, FAILED).write.mode("overwrite").option("header", True).csv(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILED).option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value")).write.mode("overwrite").text(path)


def log_metrics(rows: DataFrame, path: str) -> None:
    """Appends JSON lines with the time they were written."""
    rows.withColumn("wall_s", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def patch_set(spark: SparkSession, folder: str, manifest: DataFrame, split: str) -> DataFrame:
    """A split's patches with their image bytes: a scan of the files joined to the manifest by key."""
    f = files(spark, folder, "*.{jpg,png}").select(keys.stem(F.col("path")).alias("key"), "content")
    return conform(manifest, MANIFEST).filter(F.col("split") == split).join(f, "key")
