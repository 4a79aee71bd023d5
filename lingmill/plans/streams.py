"""Queries: streams over tables, run until their input is used up, and what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ngrams as G
from ..operators import scoring as S
from ..operators.sizes import spread
from ..session import table
from ..stages import scratch, stage
from ..streaming import stateful as T
from .ngrams import K, SMALL
from .registry import query
from .text import _L


#: Batches that a table comes in.
BATCHES = 3


def _stream(spark: SparkSession, rows: DataFrame, batch: Column | None = None) -> DataFrame:
    """rows as a stream of Parquet files in several batches: dealt at random, or by the number given."""
    dealt = stage(rows.withColumn("__batch", F.pmod(F.xxhash64(*rows.columns), F.lit(BATCHES)) if batch is None else batch), "dealt")
    path = scratch(spark, "stream")
    for k in range(BATCHES):  # one after the other, as files come by their time
        dealt.filter(F.col("__batch") == k).drop("__batch").coalesce(4 if batch is None else 1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4 if batch is None else 1).parquet(path)


def _sequenced(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with seq, their place in their key's order, and last."""
    own = Window.partitionBy(key)
    return rows.withColumn("seq", F.row_number().over(own.orderBy(*order)) - 1).withColumn("last", F.col("seq") == F.count(F.lit(1)).over(own) - 1)


def _settled(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    return T.settled(stream, scratch(spark, "streamed"), scratch(spark, "checkpoint"), mode)


#: Events come up to an hour and a half late, in batches cut by their coming.
LATE = "2 hours"


def _events(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    came = F.unix_micros("ts") + F.pmod("event_id", F.lit(90)) * 60_000_000
    low, high = events.agg(F.min(came), F.max(came)).first() or (0, 0)
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BATCHES))
    return _stream(spark, events, F.floor((came - F.lit(low or 0)) / width).cast("int"))


#: Windows that end by the last watermark are given; those behind it are still open.
_CLOSED = "(SELECT max(ts) - INTERVAL '2 hours' FROM events)"


@query("stream_tumbling", "SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL '1 hour' <= " + _CLOSED)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = _settled(spark, T.tumbling(_events(spark, d), "1 hour", LATE, "event_type"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT * FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL) WHERE start + INTERVAL '1 hour' <= " + _CLOSED)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = _settled(spark, T.sliding(_events(spark, d), "1 hour", "30 minutes", LATE, "event_type"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= {_CLOSED}""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _settled(spark, T.sessions(_events(spark, d), "30 minutes", LATE, "user_id"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal rows; the watermark outlasts the table."""
    return _settled(spark, T.deduplicated(_events(spark, d), "3650 days", "user_id", "event_type")).select("user_id", "event_type")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts in chunks of 1000 characters, numbered, the last of each known as such."""
    docs = spread(table(spark, d, "documents")).filter("text is not null")
    starts = F.expr("sequence(0, greatest(char_length(text) - 1, 0), 1000)")
    cut = docs.select(F.col("doc_id").cast("string").alias("path"), F.size(starts).alias("n"), F.posexplode(F.transform(starts, lambda i: F.substr("text", i + 1, F.lit(1000)))).alias("seq", "text"))
    return cut.select("path", "seq", (F.col("seq") == F.col("n") - 1).alias("last"), "text")


@query("stream_lines", f"WITH {_L} SELECT doc_id::VARCHAR AS path, md5(line) AS line_md5, count(*) AS n FROM l GROUP BY ALL")
def stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of chunked texts, whose chunks come in any order; the open last line comes with the last chunk."""
    out = _settled(spark, T.carry_over(_stream(spark, _chunks(spark, d))))
    return out.groupBy("path", F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_blocks", "SELECT doc_id::VARCHAR AS path, b AS block_start, md5(substr(text, b + 1, 4096)) AS block FROM (SELECT doc_id, text, unnest(range(0, length(text) - 4095, 1024)) AS b FROM documents WHERE length(text) >= 4096)")
def stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    out = _settled(spark, T.count_windows(_stream(spark, _chunks(spark, d)), 4096))
    return out.select("path", "block_start", F.md5(F.col("block").cast("binary")).alias("block"))


@query("stream_prior")
def stream_prior(spark: SparkSession, d: str) -> DataFrame:
    """Labels of lines as they come; equal to label_smoothed, whose fold it steps through."""
    docs = spread(table(spark, d, "documents"))
    scores = G.identify(G.lines(docs), G.train(docs, SMALL, K), lengths=SMALL)
    sized = G.lines(docs).select("doc_id", "line_no", F.octet_length("line").alias("size"))
    rows = S.vectors(scores, ("doc_id", "line_no")).withColumnRenamed("v", "scores").join(sized, ["doc_id", "line_no"])
    return _settled(spark, T.language_prior(_stream(spark, _sequenced(rows.select("doc_id", "line_no", "size", F.map_from_entries(F.sort_array(F.map_entries("scores"))).alias("scores")), "doc_id", "line_no").select("doc_id", "seq", "last", "line_no", "size", "scores"), F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(BATCHES)).cast("int")))).withColumn("score", F.round("score", 6))


_STRINGS = """s AS (SELECT l_orderkey::VARCHAR AS path, l_linenumber * 200 - (l_partkey % 5) * 20 AS "offset", max(60 + l_partkey % 90) AS size FROM lineitem GROUP BY ALL)"""


@query(
    "stream_redetections",
    f"""WITH {_STRINGS}, w AS (SELECT *, lag("offset" + size) OVER o AS ended, count(*) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM s WINDOW o AS (PARTITION BY path ORDER BY "offset"))
SELECT path, "offset"::BIGINT AS "offset" FROM w WHERE "offset" - coalesce(ended, 0) > 20 AND seen >= 2 AND taken >= 96""",
)
def stream_redetections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_linenumber") * 200 - (F.col("l_partkey") % 5) * 20).cast("long").alias("offset"), (60 + F.col("l_partkey") % 90).cast("int").alias("size"))
    rows = rows.groupBy("path", "offset").agg(F.max("size").alias("size"))
    return _settled(spark, T.redetections(_stream(spark, _sequenced(rows, "path", "offset"))))
