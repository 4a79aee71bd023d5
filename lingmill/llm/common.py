"""Shared plumbing of the pipeline operators: table readers, stage tables, column guards."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, table  # noqa: F401
from ..stages import drop_stage, keep, numbered, scope, shared_dir, stage  # noqa: F401


def packed_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that columns put beside it clash with none."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def sized(df: DataFrame, most: int) -> DataFrame:
    """df, a stage table, for broadcast where it has at most so many rows, else for a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows of an Arrow batch where the session names no number: whole texts are a few MB then, on both sides of the pipe.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_ready(spark: SparkSession) -> None:
    """Small Arrow batches where the session names no size, and this package on the workers."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    ship_package(spark)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers, where its caches outlive a task; other memory is given back after it."""
    arrow_ready(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(run.__module__)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


#: What empties the caches of this worker, by the module they serve.
_CACHES: dict[str, Callable[[], None]] = {}


def cached(module: str, clear: Callable[[], None]) -> None:
    """Names the caches of a module, which a worker keeps from task to task until it turns to another one."""
    _CACHES[module] = clear


def let_go(module: str) -> None:
    for other in [m for m in _CACHES if m != module]:
        _CACHES.pop(other)()


def release() -> None:
    """Hands what a task has freed back to the system, as an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fanout(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the only parallelism knob the operators use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
