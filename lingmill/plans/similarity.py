"""Queries: every dense measure of each vector against its class's first one; sparse measures; neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import similarity as S
from ..session import table
from .registry import query

_V = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(abs(x::DOUBLE), 3)) AS e FROM embeddings),
f AS (SELECT label, arg_min(e, vec_id) AS b FROM v GROUP BY label), p AS (SELECT vec_id, e AS a, b FROM v JOIN f USING (label)),
z AS (SELECT vec_id, a, b, list_zip(a, b) AS ab, list_sum(a) AS sa, list_sum(b) AS sb, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb,
  len(a)::DOUBLE AS n, list_max(a) AS ma, list_max(b) AS mb FROM p),
y AS (SELECT *, list_sum(list_transform(ab, lambda t: t[1] * t[2])) AS dot, list_sum(list_transform(ab, lambda t: least(t[1], t[2]))) AS lo, list_sum(list_transform(ab, lambda t: greatest(t[1], t[2]))) AS hi,
  list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] <> 0 THEN 1.0 ELSE 0.0 END))::DOUBLE AS bo, list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] = 0 THEN 1.0 ELSE 0.0 END))::DOUBLE AS o1,
  list_sum(list_transform(ab, lambda t: CASE WHEN t[1] = 0 AND t[2] <> 0 THEN 1.0 ELSE 0.0 END))::DOUBLE AS o2,
  list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] <> 0 THEN t[1] ELSE 0.0 END)) AS m1, list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] <> 0 THEN t[2] ELSE 0.0 END)) AS m2,
  list_sum(list_transform(ab, lambda t: abs(t[1] / sa - t[2] / sb))) AS spread FROM z)"""

_CA = "list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] <> 0 THEN least(t[1] / ma, t[2] / mb) ELSE 0.0 END))"
_CB = "list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] = 0 THEN t[1] / ma ELSE 0.0 END))"
_CC = "list_sum(list_transform(ab, lambda t: CASE WHEN t[1] = 0 AND t[2] <> 0 THEN t[2] / mb ELSE 0.0 END))"
_BY_NAME = {
    "cosine": "dot / (na * nb)",
    "euclidean": "1 - sqrt(list_sum(list_transform(ab, lambda t: (t[1] - t[2]) * (t[1] - t[2]))))",
    "manhattan": "1 - list_sum(list_transform(ab, lambda t: abs(t[1] - t[2])))",
    "jaccard": "bo / (bo + o1 + o2)", "simpson": "bo / least(bo + o1, bo + o2)", "extended_simpson": "lo / least(sa, sb)", "braun_blanquet": "lo / greatest(sa, sb)", "dice": "2 * dot / (sa + sb)",
    "anti_dice": "dot / (list_sum(list_transform(ab, lambda t: CASE WHEN t[1] <> 0 AND t[2] <> 0 THEN least(t[1], t[2]) ELSE 0.0 END)) + 2 * (sa - m1 + sb - m2))",
    "tanimoto": "CASE WHEN hi > lo THEN lo / (hi - lo) ELSE 1.0 END", "kulczynski2": "(m1 / sa + m2 / sb) / 2", "ochiai": "(m1 + m2) / 2 / sqrt(sa * sb)",
    "sokal_sneath": "(m1 + m2) / 2 / ((m1 + m2) / 2 + 2 * (sa - m1) + 2 * (sb - m2))", "mcconnaughey": "((m1 * m2 - (sa - m1) * (sb - m2)) / (sa * sb) + 1) / 2",
    "lance_williams": "1 - (sa - m1 + sb - m2) / (sa + sb)", "bray_curtis": "1 - list_sum(list_transform(ab, lambda t: abs(t[1] - t[2]))) / (sa + sb)",
    "canberra": "1 - list_sum(list_transform(ab, lambda t: CASE WHEN t[1] + t[2] > 0 THEN abs((t[1] - t[2]) / (t[1] + t[2])) ELSE 0.0 END)) / n",
    "circle_product": "lo / n", "czekanowski": "2 * lo / (sa + sb)", "robinson": "(2 - spread) / 2", "drennan": "1 - spread / 2",
    "jensen_shannon": "1 - (list_sum(list_transform(ab, lambda t: CASE WHEN t[1] > 0 THEN t[1] / sa * log2(t[1] / sa / ((t[1] / sa + t[2] / sb) / 2)) ELSE 0.0 END)) + list_sum(list_transform(ab, lambda t: CASE WHEN t[2] > 0 THEN t[2] / sb * log2(t[2] / sb / ((t[1] / sa + t[2] / sb) / 2)) ELSE 0.0 END))) / 2",
    "binary_dice": "2 * bo / (2 * bo + o1 + o2)", "binary_anti_dice": "bo / (bo + 2 * (o1 + o2))",
    "kulczynski1": "CASE WHEN sa - m1 + sb - m2 = 0 THEN m1 + m2 ELSE (m1 + m2) / 2 / (sa - m1 + sb - m2) END",
    "similarity_ratio": "CASE WHEN a = b THEN 1.7976931348623157e308 ELSE dot / (na * na + nb * nb - dot) END",
    "binary_gamma": "CASE WHEN bo * (n - bo - o1 - o2) + o1 * o2 = 0 THEN 1.0 ELSE (bo * (n - bo - o1 - o2) - o1 * o2) / (bo * (n - bo - o1 - o2) + o1 * o2) END",
    "mountford": f"CASE WHEN 2 * {_CB} * {_CC} + {_CA} * ({_CB} + {_CC}) = 0 THEN 1.0 ELSE 2 * {_CA} / (2 * {_CB} * {_CC} + {_CA} * ({_CB} + {_CC})) END",
    "fager_mcgowan": f"{_CA} / sqrt(({_CA} + {_CB}) * ({_CA} + {_CC})) - greatest({_CB}, {_CC}) / 2",
    "tripartite": f"sqrt(log2(1 + (least({_CB}, {_CC}) + {_CA}) / (greatest({_CB}, {_CC}) + {_CA})) * pow(log2(2 + least({_CB}, {_CC}) / ({_CA} + 1)), -0.5) * log2(1 + {_CA} / ({_CA} + {_CB})) * log2(1 + {_CA} / ({_CA} + {_CC})))",
}
#: Ratios of small differences are compared to fewer digits.
_DIGITS = {"kulczynski1": 4, "mountford": 6, "fager_mcgowan": 6, "tripartite": 6}


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 3)).alias("a"))
    first = v.groupBy("label").agg(F.min_by("a", "vec_id").alias("b"))
    return v.join(first, "label")


def _one(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d).select("vec_id", F.round(S.similarity(name, F.col("a"), F.col("b")), _DIGITS.get(name, 9)).alias("value"))

    run.__name__ = f"similarity_{name}"
    return run


def _names() -> list[str]:
    return [
        "cosine", "euclidean", "manhattan", "jaccard", "simpson", "extended_simpson", "braun_blanquet", "dice", "anti_dice", "tanimoto", "kulczynski1", "kulczynski2", "ochiai", "sokal_sneath", "mcconnaughey",
        "lance_williams", "bray_curtis", "canberra", "circle_product", "czekanowski", "robinson", "drennan", "similarity_ratio", "jensen_shannon", "mountford", "fager_mcgowan", "tripartite", "binary_dice", "binary_anti_dice", "binary_gamma",
    ]


for _name in _names():
    _sql = f"WITH {_V} SELECT vec_id, round({_BY_NAME[_name]}, {_DIGITS.get(_name, 9)}) AS value FROM y" if _name in _BY_NAME else None
    query(f"similarity_{_name}", _sql)(_one(_name))


@query(
    "nearest_centroid",
    """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS cluster, i, sum(x) AS c FROM v GROUP BY ALL),
n AS (SELECT cluster, sqrt(sum(c * c)) AS norm FROM c GROUP BY cluster), m AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id),
s AS (SELECT vec_id, cluster, round(sum(x * c) / (any_value(m.norm) * any_value(n.norm)), 6) AS sim FROM v JOIN c USING (i) JOIN m USING (vec_id) JOIN n USING (cluster) GROUP BY ALL)
SELECT vec_id, cluster, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster) AS r FROM s) WHERE r = 1""",
)
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as C

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    best = C.assign(v.drop("cluster"), C.centroids(v))
    return best.select("vec_id", "cluster", F.round("sim", 6).alias("sim"))


@query(
    "vector_norms",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS l2, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 5) AS l1,
round(list_max(embedding)::DOUBLE, 5) AS hi, round(list_min(embedding)::DOUBLE, 5) AS lo FROM embeddings""",
)
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda f: F.aggregate(F.transform(v, f), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(F.sqrt(total(lambda x: x * x)), 5).alias("l2"), F.round(total(F.abs), 5).alias("l1"), F.round(F.array_max(v), 5).alias("hi"), F.round(F.array_min(v), 5).alias("lo")
    )


@query(
    "vector_algebra",
    f"""WITH {_V} SELECT vec_id, round(list_sum(list_transform(ab, lambda t: t[1] + 2 * t[2])), 4) AS weighted_sum, round(list_sum(list_transform(ab, lambda t: t[1] - t[2])), 4) + 0.0 AS difference,
round(dot, 4) AS product, round(3 * sa, 4) AS scaled FROM y""",
)
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, x: s + x)
    zipped = lambda f: F.round(total(F.zip_with("a", "b", f)), 4)
    return _pairs(spark, d).select(
        "vec_id", zipped(lambda x, y: x + 2 * y).alias("weighted_sum"), (zipped(lambda x, y: x - y) + 0.0).alias("difference"), zipped(lambda x, y: x * y).alias("product"), F.round(3 * total(F.col("a")), 4).alias("scaled")
    )


_TERMS = """t0 AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS term FROM documents),
t AS (SELECT source, term, count(*)::DOUBLE AS w FROM t0 GROUP BY ALL), n AS (SELECT source, sqrt(sum(w * w)) AS l2, sum(w) AS l1 FROM t GROUP BY source)"""


@query(
    "sparse_similarity",
    f"""WITH {_TERMS}, d AS (SELECT a.source AS s1, b.source AS s2, sum(a.w * b.w) AS dot, sum(least(a.w, b.w)) AS low, count(*) AS shared FROM t a JOIN t b ON a.term = b.term AND a.source < b.source GROUP BY ALL),
k AS (SELECT source, count(*) AS kinds FROM t GROUP BY source)
SELECT s1, s2, round(dot / (x.l2 * y.l2), 6) AS cosine, round(1 - sqrt(greatest(x.l2 * x.l2 + y.l2 * y.l2 - 2 * dot, 0)) / (x.l2 + y.l2), 6) AS euclidean, round(1 - (x.l1 + y.l1 - 2 * low) / (x.l1 + y.l1), 6) AS manhattan,
  round(low / (p.kinds + q.kinds - shared), 6) AS circle_product FROM d JOIN n x ON x.source = s1 JOIN n y ON y.source = s2 JOIN k p ON p.source = s1 JOIN k q ON q.source = s2""",
)
def sparse_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Sources as sparse term vectors; vectors meet by term, so only shared terms are paired."""
    term = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("term")
    t = table(spark, d, "documents").select("source", term).groupBy("source", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    n = t.groupBy("source").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l2"), F.sum("w").alias("l1"), F.count(F.lit(1)).alias("kinds"))
    named = lambda df, k: df.select(*(F.col(c).alias(f"{c}{k}" if c != "term" else c) for c in df.columns))
    met = named(t, 1).join(named(t, 2), "term").filter("source1 < source2")
    dots = met.groupBy("source1", "source2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"), F.sum(F.least("w1", "w2")).alias("low"), F.count(F.lit(1)).alias("shared"))
    out = dots.join(named(n, 1), "source1").join(named(n, 2), "source2")
    return out.select(
        F.col("source1").alias("s1"), F.col("source2").alias("s2"), F.round(F.expr("dot / (l21 * l22)"), 6).alias("cosine"), F.round(F.expr("1 - sqrt(greatest(l21 * l21 + l22 * l22 - 2 * dot, 0)) / (l21 + l22)"), 6).alias("euclidean"),
        F.round(F.expr("1 - (l11 + l12 - 2 * low) / (l11 + l12)"), 6).alias("manhattan"), F.round(F.expr("low / (kinds1 + kinds2 - shared)"), 6).alias("circle_product"),
    )


@query(
    "bounded_neighbours",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, other, round(sim, 6) AS sim, place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS place FROM s) WHERE place <= 5""",
)
def bounded_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of each vector inside its label, by blocks of vectors."""
    from ..operators import cluster as C

    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    near = C.neighbours(v, 5)
    w = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "other")
    return near.withColumn("place", F.row_number().over(w)).select("vec_id", "other", F.round("sim", 6).alias("sim"), "place")
