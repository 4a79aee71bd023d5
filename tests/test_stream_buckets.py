"""Keys of a stream that share a state row."""

from pyspark.sql import functions as F

from lingmill.streaming import stateful


def test_many_keys_take_few_calls(spark, tmp_path):
    """Keys are dealt to buckets: a call and a state row a bucket, where there was one for every key."""
    for k in range(2):
        spark.range(3000).select(F.col("id").alias("path"), F.lit(1 - k).alias("seq"), F.lit(k == 0).alias("last"), F.lit("b\nc" if k == 0 else "a").alias("text")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path long, seq int, last boolean, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = stateful.in_order(stream, "path", ["text"], "", lambda key, carried, row: (carried + row[0], []), lambda key, text: [(key, text)], "path long, text string")
    q = told.writeStream.format("memory").queryName("bucketed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= stateful.BUCKETS < 3000
    assert {(r.path, r.text) for r in spark.table("bucketed").collect()} == {(k, "ab\nc") for k in range(3000)}
