"""Stage tables: results written to the folder that all executors share, and read again."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []
#: The lists of stage tables of the open scopes, innermost last.
_OPEN: contextvars.ContextVar[tuple] = contextvars.ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Only a local session may leave it unset (tests): a folder of this process serves then. On a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="stages-"))
    return f"file://{_LOCAL_DIR[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    The written table cuts the lineage and survives the loss of any executor; row ids that
    were drawn on the way are fixed by it. It is deleted by drop_stage(), at the end of the
    scope() it was made in, or when the session ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    if _OPEN.get():
        _OPEN.get()[-1].append(out)
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a plan that ends inside go at its end: its result is a table, no later plan reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target, files = _hadoop(spark, path)
    files.deleteOnExit(target)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop(spark, path)
    return files.exists(target)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_stage(df: DataFrame) -> None:
    """Deletes a table made by stage() that no later result reads."""
    path = getattr(df, "_stage_path", None)
    if path is not None:
        target, files = _hadoop(df.sparkSession, path)
        files.delete(target, True)


@contextmanager
def scope() -> Iterator[None]:
    """Stage tables made inside are deleted at its end, but for those of keep()."""
    held: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), held))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for df in held:
            drop_stage(df)


def keep(df: DataFrame, name: str = "result") -> DataFrame:
    """A stage table that outlives the innermost scope; the one around it, if any, holds it."""
    token = _OPEN.set(_OPEN.get()[:-1])
    try:
        return stage(df, name)
    finally:
        _OPEN.reset(token)


def numbered(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """df with 0, 1, 2 ... in the given order as column name, whatever the number of partitions.

    within follows in the order, but takes no part in the bounds of the ranges. Two levels: places inside range partitions, and the counts of these, one row each.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order, *(within or []))
    placed = stage(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    first = counts.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__first"))
    return placed.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")
