"""Expressions and storage helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of a bitmap's bits: 8 MB, whatever the input's size.
BITS = 26
#: Bytes of an Arrow batch of whole texts or sets, about; a longer row goes alone.
BATCH = 1 << 22

#: ASCII white space, as the contracts name it: \x20 and \x09-\x0D.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
NOT_SPACE = "[^ \\t\\n\\x0B\\f\\r]"
#: Lets a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables and broadcasts made in the innermost alone(), each with what takes it back.
_MADE: ContextVar[list[tuple[object, Callable[[], object]]] | None] = ContextVar("made", default=None)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does the same, faster, where every character takes one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The runs of characters that are not ASCII white space, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or an own one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage is cut, a lost executor costs no recomputation, and the planner knows the size. Nothing reads the shuffle files again, so they go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append((out, lambda: _deleted(spark, path)))
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shipped(spark: SparkSession, value: bytes) -> Broadcast:
    """value broadcast, until the innermost alone() ends."""
    out = spark.sparkContext.broadcast(value)
    if (made := _MADE.get()) is not None:
        made.append((out, out.destroy))
    return out


def alone(make: Callable[[], tuple[DataFrame | None, ...]], *names: str) -> list[DataFrame | None]:
    """The frames of make(), written under these names if they aren't yet. What else written() and shipped() made on the way is taken back: nothing else may read it."""
    made: list[tuple[object, Callable[[], object]]] = []
    outer, token, out = _MADE.get(), _MADE.set(made), []
    try:
        for df, name in zip(make(), names, strict=True):
            out.append(df if df is None or any(df is x for x, _ in made) else written(df, name))
    finally:
        _MADE.reset(token)
        for x, undo in made:
            if not any(x is df for df in out):
                undo()
            elif outer is not None:
                outer.append((x, undo))
    return out


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold about BATCH bytes, if the session lets them hold more: executors and workers keep several of whole texts or sets at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(c: Column) -> Column:
    """c, which the optimizer then neither copies nor moves into what uses it: inside a lambda it would be evaluated for every element."""
    return F.when(F.spark_partition_id() >= 0, c)


def may_hold(keys: DataFrame, col: str, bits: int = BITS) -> Callable[[Column], Column]:
    """Whether the long column `col` of keys may have a value: no false negatives. A bitmap of fixed size, built by the executors and given to the plan as a subquery of one row; expressions only, so rows that nothing meets need not be shuffled."""
    slot = lambda c: F.pmod(c, F.lit(1 << bits)) + 1
    found = keys.select(slot(F.col(col)).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    empty = keys.sparkSession.range(1, ((1 << bits) >> 15) + 1).select(F.col("id").alias("b"), F.unhex(F.lit("00" * 4096)).alias("m"))
    every = found.unionByName(empty).groupBy("b").agg(F.bitmap_or_agg("m").alias("m"))
    whole = written(every.agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("x")).select(F.transform("x", lambda x: x["m"]).alias("x")), "bitmap")

    def test(c: Column) -> Column:
        at = slot(c)
        byte = F.substring(F.get(whole.scalar(), (F.bitmap_bucket_number(at) - 1).cast("int")), F.floor(F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.bitmap_bit_position(at) % 8).cast("int")) == 1

    return test


def without(lines: Column, gone: Column) -> Column:
    """The elements of an array but for those at the places `gone`, in time linear in both. lines is a column under once()."""
    kept = F.array_except(F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>")), gone)
    return F.transform(kept, lambda i: F.get(lines, i))
