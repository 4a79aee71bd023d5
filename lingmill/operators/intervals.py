"""Intervals and text spans: merging, coverage, order, removal and combination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How two scores or weights of one span become one.
COMBINE = {"add": F.sum, "product": F.product, "min": F.min, "max": F.max, "average": F.avg}


def merged(rows: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """key, lo, hi, n: half-open intervals of a key that overlap or touch, as one each.

    A key's intervals are sorted in one task; a hot key should be split by ranges of lo first.
    """
    before = Window.partitionBy(key).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key).orderBy(lo, hi)
    opens = F.when(F.max(hi).over(before) >= F.col(lo), 0).otherwise(1)
    island = rows.select(key, lo, hi, opens.alias("opens")).withColumn("island", F.sum("opens").over(order))
    return island.groupBy(key, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("island")


def covered(points: DataFrame, intervals: DataFrame, key: str, at: str = "at") -> DataFrame:
    """The points with whether an interval [lo, hi) of merged() holds them, in one sort and no range join."""
    marks = intervals.select(key, F.col("lo").alias("__at"), F.lit(0).alias("__kind"), F.col("hi").alias("__hi"), F.lit(None).cast(points.schema).alias("__row"))
    asked = points.select(key, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(intervals.schema["hi"].dataType).alias("__hi"), F.struct(*points.columns).alias("__row"))
    last = F.last("__hi", True).over(Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return marks.unionByName(asked).withColumn("__last", last).filter("__kind = 1").select("__row.*", F.coalesce(F.col("__at") < F.col("__last"), F.lit(False)).alias("covered"))


def span_order(spans: Column) -> Column:
    """Spans (start, end, score, weight, ...) by start, the longest first, then score and weight from the top."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"], -s["end"], -s["score"], -s["weight"], s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def without(spans: Column, doomed: Callable[[Column], Column]) -> Column:
    """The spans that do not satisfy the predicate."""
    return F.filter(spans, lambda s: ~F.coalesce(doomed(s), F.lit(False)))


def combined(spans: DataFrame, key: list[str], score: str = "add", weight: str = "max") -> DataFrame:
    """One span for each key, start and end, its scores and weights combined by the named rules."""
    return spans.groupBy(*key, "start", "end").agg(COMBINE[score]("score").alias("score"), COMBINE[weight]("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
