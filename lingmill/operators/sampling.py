"""Sampling of lines: interval, length, uniform by lines or bytes, random, diversity; rejects.

Lines carry a global number. Uniform samples use closed forms in whole numbers where there is
one; the byte sample is a recurrence over lines and is folded along them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import numbered as by_ranges


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """i, the 0-based place of every row in this order, in two levels.

    The range sort is written as a stage table: run twice, for the rows and for the counts, its
    bounds are sampled anew and its partitions merged differently, and numbers go astray.
    """
    return by_ranges(rows, list(order), "i")


def every_nth(i: Column, n: int) -> Column:
    return i % n == 0


def of_length(line: Column, low: int, high: int) -> Column:
    """Bytes with the newline, both bounds included."""
    return (F.octet_length(line) + 1).between(low, high)


def uniform_lines(i: Column, n: int, total: Column) -> Column:
    """n of total lines, evenly spread, the first half a step in."""
    return F.floor((2 * i + 3) * n / (2 * total)) > F.floor((2 * i + 1) * n / (2 * total))


def uniform_bytes(sizes: Column, n: int) -> Column:
    """From an ordered array of sizes: a line is kept while the bytes kept so far are within the rate of
    those seen so far.

    The rate is (n + 1) / total bytes.
    """
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("got"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x
        keep = acc["got"] * total <= acc["seen"] * (n + 1)
        return F.struct(seen.alias("seen"), (acc["got"] + F.when(keep, x).otherwise(0)).alias("got"), F.array_append(acc["keep"], keep).alias("keep"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["keep"])


def random_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement; the draw of a row is the MD5 of the seed and all its columns."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).cast("binary"))
    return rows.orderBy(draw, *rows.columns).limit(n)


def similarity_ordered(vectors: DataFrame) -> DataFrame:
    """vec_id, v, score of a small set, by the sum of squared cosines to all others, the least alike first.

    The set is a sample of at most a documented size, which its caller draws; it is broadcast to itself.
    """
    from .cluster import cosine

    other = F.broadcast(vectors.select(F.col("vec_id").alias("other"), F.col("v").alias("w")))
    near = vectors.join(other, F.col("vec_id") != F.col("other"), "left").withColumn("s", F.coalesce(F.pow(cosine(F.col("v"), F.col("w")), F.lit(2)), F.lit(0.0)))
    return near.groupBy("vec_id").agg(F.first("v").alias("v"), F.round(F.sum("s"), 6).alias("score")).orderBy("score", "vec_id")


def diversity_sample(vectors: DataFrame, n: int, of: int, seed: int = 0) -> DataFrame:
    """The n least alike of a random sample of so many vectors."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")).cast("binary"))
    return similarity_ordered(vectors.orderBy(draw, "vec_id").limit(of)).limit(n)


def rejects(rows: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(kept.select(*key), key, "left_anti")
