"""Broadcast behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import stage

BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, written once as a stage table and counted, for broadcast where it has few rows; else for a shuffle join."""
    df = stage(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def spread(scan: DataFrame) -> DataFrame:
    """A table scan dealt over the session's cores where its files give fewer tasks than that.

    Large tables have a task per split and stay as they are; only a few small files, whose
    rows would be worked on by one core, are shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
