"""Queries: list, set, map and bit-vector algebra over per-customer order lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import table
from .registry import query

_SQL = """WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS a, list((l_partkey % 7)::INT ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, {} FROM l"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda x: x["l_linenumber"]).alias("a"), F.transform("x", lambda x: (x["l_partkey"] % 7).cast("int")).alias("b"))


@query(
    "list_sets",
    _SQL.format(
        "list_concat(list_filter(b, lambda x: NOT list_contains(a, x)), a) AS l_union, list_filter(a, lambda x: list_contains(b, x)) AS l_both,"
        " list_filter(a, lambda x: NOT list_contains(b, x)) AS l_less, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) = 0 AS subset, list_has_any(a, b) AS meets, list_sort(a) = list_sort(b) AS same"
    ),
)
def list_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _lists(spark, d).select(
        "l_orderkey", A.list_union(a, b).alias("l_union"), A.list_intersection(a, b).alias("l_both"), A.list_difference(a, b).alias("l_less"), A.is_subset(a, b).alias("subset"), A.intersects(a, b).alias("meets"), A.same_set(a, b).alias("same")
    )


@query(
    "list_places",
    _SQL.format(
        "coalesce(list_position(b, 3), 0) - 1 AS first_at, CASE WHEN list_contains(b, 3) THEN len(b) - list_position(list_reverse(b), 3) ELSE -1 END AS last_at, b[2] AS second, b[2:3] AS mid, b[2:] AS tail, b[-1] AS final,"
        " list_concat(b[:1], b[3:]) AS cut, list_concat(b[:0], [99], b[1:]) AS put, list_reverse(b) AS back, list_filter(b, lambda x: x <> 3) AS without"
    ),
)
def list_places(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    return _lists(spark, d).select(
        "l_orderkey", A.position(b, F.lit(3)).alias("first_at"), A.last_position(b, F.lit(3)).cast("long").alias("last_at"), A.nth(b, 1).alias("second"), A.between(b, 1, 2).alias("mid"), A.rest(b).alias("tail"), A.last(b).alias("final"),
        A.without_span(b, 1, 1).alias("cut"), A.insert_at(b, 0, F.lit(99)).alias("put"), F.reverse(b).alias("back"), F.array_remove(b, 3).alias("without"),
    )


@query(
    "list_mapping",
    _SQL.format(
        "list_transform(b, lambda x: x * x) AS squares, flatten(list_transform(b, lambda x: [x, x + 1])) AS pairs, list_distinct_sorted AS kinds, CASE WHEN list_contains(b, 5) THEN b ELSE list_append(b, 5) END AS pushed, list_sort(b) AS sorted, list_sum(b)::BIGINT AS total"
    ).replace("list_distinct_sorted", "list_sort(list_distinct(b))"),
)
def list_mapping(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    return _lists(spark, d).select(
        "l_orderkey", A.map_each(b, lambda x: x * x).alias("squares"), A.flat_map(b, lambda x: F.array(x, x + 1)).alias("pairs"), F.sort_array(F.array_distinct(b)).alias("kinds"), A.push_if_new(b, F.lit(5)).alias("pushed"),
        F.sort_array(b).alias("sorted"), F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
    )


@query("list_sublist", _SQL.format("CASE WHEN len(b) < 2 THEN -1 ELSE coalesce(list_min(list_filter(range(1, len(b)), lambda i: b[i] = 1 AND b[i + 1] = 2)), 0) - 1 END::INT AS at"))
def list_sublist(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("l_orderkey", A.sublist_at(F.col("b"), F.array(F.lit(1), F.lit(2))).alias("at"))


@query("list_association", _SQL.format("b[list_position(a, 2)] AS found"))
def list_association(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("l_orderkey", F.when(F.array_contains("a", 2), A.association(F.col("a"), F.col("b"), F.lit(2))).alias("found"))


@query(
    "sparse_gap_fill",
    """WITH m AS (SELECT l_orderkey, l_linenumber AS k, max(l_partkey % 7)::INT AS v FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey, min(k) AS lo, max(k) AS hi FROM m GROUP BY l_orderkey),
g AS (SELECT l_orderkey, unnest(range(lo, hi + 1))::INT AS k FROM r) SELECT l_orderkey, list(coalesce(v, -1) ORDER BY g.k) AS filled FROM g LEFT JOIN m USING (l_orderkey, k) GROUP BY l_orderkey""",
)
def sparse_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey") % 7).cast("int").alias("v"))
    sparse = cells.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "v"))).alias("m"))
    return sparse.select("l_orderkey", A.gap_filled(F.col("m"), F.lit(-1)).alias("filled"))


@query(
    "bit_vectors",
    """WITH v AS (SELECT l_orderkey, bit_or(1::BIGINT << (l_partkey % 60)) AS a, bit_or(1::BIGINT << (l_suppkey % 60)) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a | b AS bits_union, a & b AS bits_both, a & ~b AS bits_less, ~a AS bits_not, bit_count(a | b)::INT AS n_union, bit_count(a & b)::INT AS n_both, bit_count(a & ~b)::INT AS n_less FROM v""",
)
def bit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1L, cast(l_partkey % 60 as int))")).alias("a"), F.bit_or(F.expr("shiftleft(1L, cast(l_suppkey % 60 as int))")).alias("b"))
    return v.select("l_orderkey", *(c.alias(n) for n, c in A.bit_algebra(F.col("a"), F.col("b")).items()))


@query("table_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def table_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("table_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def table_intersection(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    return items.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(items.filter("l_discount > 0.08").select("l_partkey"))


@query("table_difference", "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def table_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").filter("l_quantity > 25").select("l_partkey"))


@query("bounded_queue", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def bounded_queue(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("o_custkey", "o_orderkey", "place")


@query("distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("hash_aggregate", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS lowest, max(l_quantity) AS highest FROM lineitem GROUP BY l_returnflag")
def hash_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("l_quantity").alias("lowest"), F.max("l_quantity").alias("highest"))
