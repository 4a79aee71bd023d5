"""Queries: joins of every kind, frames with inheritance, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames as R
from ..session import table
from .registry import query


@query("join_equi", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_full_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) + coalesce(y, 0) AS total FROM (SELECT l_partkey AS k, count(*) AS x FROM lineitem WHERE l_quantity > 45 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS y FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) b ON a.k = b.k")
def join_full_merge(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    count = lambda df, n: df.groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    both = count(items.filter("l_quantity > 45"), "x").join(count(items.filter("l_discount > 0.09"), "y"), "k", "full")
    return both.select("k", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("total"))


@query("join_range_steps", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 2.0 WHEN p_size < 20 THEN 1.5 WHEN p_size < 40 THEN 1.2 ELSE 1.0 END::DOUBLE AS threshold FROM part")
def join_range_steps(spark: SparkSession, d: str) -> DataFrame:
    """A step function from (start, threshold) pairs: four rows, so a broadcast."""
    steps = spark.createDataFrame([(0, 2.0), (10, 1.5), (20, 1.2), (40, 1.0)], "lo int, threshold double")
    ranges = steps.withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("lo")), F.lit(2147483647)))
    return table(spark, d, "part").join(F.broadcast(ranges), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi"))).select("p_partkey", "threshold")


@query("join_prefix", "SELECT a.p_type AS head, count(*) AS n FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS p_type FROM part) a JOIN part b ON starts_with(b.p_type, a.p_type) GROUP BY 1")
def join_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Heads end at a blank, so the prefix join is an equality on the cut text."""
    part = table(spark, d, "part")
    cut = F.substring_index("p_type", " ", 1)
    return part.select(cut.alias("head")).distinct().join(part.select(cut.alias("head")), "head").groupBy("head").agg(F.count(F.lit(1)).alias("n"))


@query("join_zip", "WITH n AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) AS i FROM documents) SELECT a.doc_id, b.source FROM (SELECT i, doc_id FROM n) a JOIN (SELECT i, source FROM n) b USING (i)")
def join_zip(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import numbered

    docs = table(spark, d, "documents")
    a, b = numbered(docs.select("doc_id"), "doc_id"), numbered(docs.select("doc_id", "source"), "doc_id").select("i", "source")
    return a.join(b, "i").select("doc_id", "source")


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, nations and regions as frames; each is part of the next."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    row = lambda df, frame, slot, filler: df.select(frame.alias("frame"), F.lit(slot).alias("slot"), F.lit("VALUE").alias("facet"), F.lit(0).alias("pos"), filler.cast("string").alias("filler"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    frames = row(c, name("c", "c_custkey"), "segment", F.col("c_mktsegment")).unionByName(row(n, name("n", "n_nationkey"), "nation", F.col("n_name"))).unionByName(row(r, name("r", "r_regionkey"), "region", F.col("r_name")))
    edges = c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).unionByName(n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    return frames, edges


_E = "RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), up AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT up.src, e.dst, depth + 1 FROM up JOIN e ON up.dst = e.src)"


@query("frame_ancestors", f"WITH {_E} SELECT src, dst, min(depth) AS depth FROM up GROUP BY ALL")
def frame_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return R.ancestors(_frames(spark, d)[1])


@query("frame_part_of", f"WITH {_E} SELECT DISTINCT src FROM up WHERE dst = 'r1'")
def frame_part_of(spark: SparkSession, d: str) -> DataFrame:
    return R.ancestors(_frames(spark, d)[1]).filter("dst = 'r1'").select("src").distinct()


@query("frame_inherited", f"""WITH {_E}, f AS (SELECT 'c' || c_custkey AS frame, 'segment' AS slot, c_mktsegment AS filler FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', r_name FROM region)
SELECT frame, slot, filler, 0 AS depth FROM f UNION ALL SELECT src, slot, filler, min(depth) FROM up JOIN f ON frame = dst GROUP BY ALL""")
def frame_inherited(spark: SparkSession, d: str) -> DataFrame:
    frames, edges = _frames(spark, d)
    return R.inherited(frames, R.ancestors(edges)).select("frame", "slot", "filler", "depth")


@query("frame_inverse", f"WITH {_E} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def frame_inverse(spark: SparkSession, d: str) -> DataFrame:
    return R.with_inverse(_frames(spark, d)[1])


@query("frame_fillers", "SELECT 'n' || n_nationkey AS frame, list('c' || c_custkey ORDER BY c_custkey) AS fillers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def frame_fillers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("frame"), F.lit("member").alias("slot"), F.lit("VALUE").alias("facet"), F.row_number().over(w).alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("filler"))
    return R.collected(rows).select("frame", "fillers")


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("events_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("events_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def events_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query(
    "grow_seeds",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label AS cluster, arg_min(e, vec_id) AS c FROM v GROUP BY label),
s AS (SELECT vec_id, cluster, round(list_cosine_similarity(e, c), 9) AS sim FROM v CROSS JOIN c)
SELECT vec_id, cluster, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster) AS r FROM s) WHERE r = 1 AND sim >= 0.1""",
)
def grow_seeds(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as C

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    seeds = v.groupBy("cluster").agg(F.min_by("v", "vec_id").alias("c"))
    return C.grow_seeds(v, seeds, 0.1).select("vec_id", "cluster", F.round("sim", 6).alias("sim"))


@query("cluster_k_means")
def cluster_k_means(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as C

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return C.k_means(v.drop("cluster"), v.groupBy("cluster").agg(F.min_by("v", "vec_id").alias("c")), 5)


_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT * FROM v WHERE vec_id < 40)"


@query(
    "cluster_vector_linkage",
    f"""WITH {_V}, p AS (SELECT a.vec_id, b.label AS cluster, list_cosine_similarity(a.e, b.e) AS s FROM v a CROSS JOIN m b)
SELECT vec_id, cluster, round(avg(s), 6) AS average, round(sqrt(avg(s * s)), 6) AS rms, round(max(s) / sqrt(count(*)), 6) AS nearest, round(min(s) / sqrt(count(*)), 6) AS furthest FROM p GROUP BY ALL""",
)
def cluster_vector_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the clusters of the first forty."""
    from ..operators import cluster as C

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = None
    for kind in ("average", "rms", "nearest", "furthest"):
        one = C.vector_linkage(v.drop("cluster"), v.filter("vec_id < 40"), kind).select("vec_id", "cluster", F.round("sim", 6).alias(kind))
        out = one if out is None else out.join(one, ["vec_id", "cluster"])
    return out


@query("cluster_merged_equivalent", "WITH n AS (SELECT DISTINCT label, label % 3 AS name FROM embeddings) SELECT vec_id, min(n.label) OVER (PARTITION BY name) AS cluster FROM embeddings e JOIN n ON e.label = n.label")
def cluster_merged_equivalent(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as C

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return C.merged_equivalent(v, v.select("cluster", (F.col("cluster") % 3).alias("name")).distinct())
