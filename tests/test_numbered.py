"""Global numbers of more rows than range bounds are sampled from."""

from pyspark.sql import functions as F

from lingmill.operators.sampling import numbered


def test_numbers_are_gapless(spark):
    """The counts need no column but the order, so their range sort was another than that of the rows."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = spark.range(0, 100_000, 1, 4).select(F.xxhash64("id").alias("a"), F.concat(F.lit("line "), F.col("id")).alias("line"))
        got = sorted((r.a, r.i) for r in numbered(rows, "a").select("a", "i", "line").collect())
    finally:
        spark.conf.set(name, before)
    assert [i for _, i in got] == list(range(100_000))
