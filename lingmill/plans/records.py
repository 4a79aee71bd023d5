"""Queries: spans and intervals, records in strings, weights, linkage between clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import cluster as C
from ..operators import intervals as I
from ..operators import ngrams as G
from ..operators import strings as S
from ..session import table
from .registry import query

_SPANS = "s AS (SELECT l_orderkey AS k, l_partkey % 7 AS start, l_partkey % 7 + l_linenumber AS \"end\", l_discount AS score, l_tax AS weight, l_partkey AS part FROM lineitem)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") % 7
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"), F.col("l_discount").alias("score"), F.col("l_tax").alias("weight"), F.col("l_partkey").alias("part"))


@query("span_ordered", f"WITH {_SPANS} SELECT k, list(part ORDER BY start, \"end\" DESC, score DESC, weight DESC, part) AS parts FROM s GROUP BY k")
def span_ordered(spark: SparkSession, d: str) -> DataFrame:
    spans = F.collect_list(F.struct("start", "end", "score", "weight", "part"))
    return _spans(spark, d).groupBy("k").agg(F.transform(I.span_order(spans), lambda s: s["part"]).alias("parts"))


@query("span_filtered", f"WITH {_SPANS} SELECT k, count(*) FILTER (score < 0.05) AS kept, count(*) AS total FROM s GROUP BY k")
def span_filtered(spark: SparkSession, d: str) -> DataFrame:
    grouped = _spans(spark, d).groupBy("k").agg(F.collect_list(F.struct("start", "end", "score")).alias("spans"))
    return grouped.select("k", F.size(I.without(F.col("spans"), lambda s: s["score"] >= 0.05)).cast("long").alias("kept"), F.size("spans").cast("long").alias("total"))


@query("span_merged", f"WITH {_SPANS} SELECT k, start, \"end\", round(sum(score), 6) AS score, max(weight) AS weight, count(*) AS n FROM s GROUP BY ALL")
def span_merged(spark: SparkSession, d: str) -> DataFrame:
    return I.combined(_spans(spark, d), ["k"]).withColumn("score", F.round("score", 6))


_ISLANDS = """v AS (SELECT user_id, event_id AS lo, event_id + 1500 AS hi FROM events WHERE event_type = 'click'),
o AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS opens FROM v),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY lo, hi) AS island FROM o), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, island)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "events").filter("event_type = 'click'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 1500).alias("hi"))
    return I.merged(clicks, "user_id")


@query("interval_merged", f"WITH {_ISLANDS} SELECT user_id, lo, hi, n FROM m")
def interval_merged(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query("interval_covered", f"WITH {_ISLANDS} SELECT event_id, e.user_id, EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND e.event_id >= m.lo AND e.event_id < m.hi) AS covered FROM events e")
def interval_covered(spark: SparkSession, d: str) -> DataFrame:
    return I.covered(table(spark, d, "events").select("event_id", "user_id"), _merged(spark, d), "user_id", "event_id")


@query("tagged_words", "SELECT c_custkey, string_split(c_name, '#')[1] AS word, list_filter(string_split(c_name, '#')[2:], lambda x: x <> '') AS tags FROM customer")
def tagged_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", R.tagged_word(F.col("c_name"), "#").alias("t")).select("c_custkey", "t.word", "t.tags")


@query("path_parts", r"SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS dir, regexp_extract(url, '[^/]*$') AS base, regexp_extract(regexp_extract(url, '[^/]*$'), '\.([^.]*)$', 1) AS ext, regexp_replace(url, '\.[^./]*$', '') || '.txt' AS forced FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", R.directory(u).alias("dir"), R.base_name(u).alias("base"), R.extension(u).alias("ext"), R.with_extension(u, "txt").alias("forced"))


@query("number_parsing", "SELECT c_custkey, try_cast(regexp_extract(c_name, '-?[0-9]+') AS BIGINT) AS number FROM customer")
def number_parsing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", R.whole_number(F.col("c_name")).alias("number"))


@query("url_codec", "SELECT page_id, url_encode(url) AS coded, url_decode(url_encode(url)) AS plain, md5(url) AS digest FROM pages")
def url_codec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.url_encode("url").alias("coded"), F.try_url_decode(F.url_encode("url")).alias("plain"), F.md5(F.col("url").cast("binary")).alias("digest"))


@query(
    "prefix_completion",
    """WITH g AS (SELECT substr(p_type, 1, 2) AS prefix, min(p_type) AS a, max(p_type) AS b, count(DISTINCT p_type) AS n FROM part GROUP BY 1)
SELECT prefix, n, substr(a, 1, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i)))) AS completed FROM g""",
)
def prefix_completion(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy(F.substring("p_type", 1, 2).alias("prefix")).agg(F.min("p_type").alias("a"), F.max("p_type").alias("b"), F.count_distinct("p_type").alias("n"))
    return g.select("prefix", "n", R.completion(F.col("a"), F.col("b")).alias("completed"))


@query(
    "confidence_blended",
    """SELECT p_partkey, round(least(conf * (1 - w) + 10 * raw * w, 99.999), 6) AS blended FROM (SELECT p_partkey, p_retailprice / 100 AS conf, p_size / 25.0::DOUBLE AS raw,
CASE WHEN p_size * 2 <= 8 THEN 0.25::DOUBLE WHEN p_size * 2 <= 20 THEN 1 / 3::DOUBLE WHEN p_size * 2 <= 40 THEN 0.5::DOUBLE WHEN p_size * 2 <= 60 THEN 2 / 3::DOUBLE WHEN p_size * 2 <= 80 THEN 0.8::DOUBLE ELSE 0.875::DOUBLE END AS w FROM part)""",
)
def confidence_blended(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(S.blended(F.col("p_retailprice") / 100, F.col("p_size") / F.lit(25.0), F.col("p_size") * 2), 6).alias("blended"))


@query(
    "weight_scaling",
    """SELECT p_partkey, round(pow(100 * p, 0.5::DOUBLE), 8) AS root, round(4 * ln(1 + p * 20) / ln(21::DOUBLE), 8) AS logarithm, round(100 * p, 8) AS plain, round(p, 8) AS restored, round(p, 8) AS restored_log,
least(greatest(floor(100 * p * 1e9 + 0.5), 1), 4294967295)::BIGINT AS fixed FROM (SELECT p_partkey, p_size / 5000::DOUBLE AS p FROM part)""",
)
def weight_scaling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") / F.lit(5000.0)).alias("p"))
    p = F.col("p")
    return rows.select(
        "p_partkey", F.round(G.scaled(p, 0.5), 8).alias("root"), F.round(G.scaled(p, -20.0), 8).alias("logarithm"), F.round(G.scaled(p, 0), 8).alias("plain"),
        F.round(G.unscaled(G.scaled(p, 0.5), 0.5), 8).alias("restored"), F.round(G.unscaled(G.scaled(p, -20.0), -20.0), 8).alias("restored_log"), G.percent_fixed(p, F.lit(1.0)).alias("fixed"),
    )


@query(
    "cluster_average_linkage",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.label AS one, b.label AS two, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS linkage FROM v a JOIN v b ON a.label < b.label GROUP BY ALL""",
)
def cluster_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return C.average_linkage(v).select("one", "two", F.round("linkage", 6).alias("linkage"))


@query("cluster_trimmed", "SELECT vec_id, label AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS place FROM embeddings) WHERE place <= 10")
def cluster_trimmed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.get("embedding", F.lit(0)).alias("score"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "vec_id"))).filter("place <= 10").select("vec_id", "cluster")
