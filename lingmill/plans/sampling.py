"""Queries: sampling of document lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators.ngrams import lines
from ..session import table
from .registry import query

_L = """l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l0),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i, count(*) OVER () AS total FROM l)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(table(spark, d, "documents"), keep=("doc_id",)).withColumn("line_no", F.col("line_no").cast("long"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered(_lines(spark, d), "doc_id", "line_no")


@query("sample_interval", f"WITH {_L} SELECT doc_id, line_no FROM n WHERE i % 3 = 0")
def sample_interval(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).filter(S.every_nth(F.col("i"), 3)).select("doc_id", "line_no")


@query("sample_interval_rejects", f"WITH {_L} SELECT doc_id, line_no FROM n WHERE i % 3 <> 0")
def sample_interval_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).filter(~S.every_nth(F.col("i"), 3)).select("doc_id", "line_no")


@query("sample_length", f"WITH {_L} SELECT doc_id, line_no FROM l WHERE octet_length(encode(line)) + 1 BETWEEN 25 AND 65")
def sample_length(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter(S.of_length(F.col("line"), 25, 65)).select("doc_id", "line_no")


@query("sample_uniform_lines", f"WITH {_L} SELECT doc_id, line_no FROM n WHERE ((2 * i + 3) * 500) // (2 * total) > ((2 * i + 1) * 500) // (2 * total)")
def sample_uniform_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d)
    total = _lines(spark, d).count()
    return rows.filter(S.uniform_lines(F.col("i"), 500, F.lit(total))).select("doc_id", "line_no")


@query(
    "sample_uniform_bytes",
    """WITH RECURSIVE l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, list_sum(list_transform(ls, lambda x: octet_length(encode(x)) + 1)) AS total FROM l0),
w AS (SELECT doc_id, ls, total, 0 AS k, 0::HUGEINT AS seen, 0::HUGEINT AS got, false AS keep FROM l
  UNION ALL SELECT doc_id, ls, total, k + 1, seen + octet_length(encode(ls[k + 1])) + 1,
    got + CASE WHEN got * total <= seen * 201 THEN octet_length(encode(ls[k + 1])) + 1 ELSE 0 END, got * total <= seen * 201 FROM w WHERE k < len(ls))
SELECT doc_id, k::BIGINT - 1 AS line_no FROM w WHERE keep""",
)
def sample_uniform_bytes(spark: SparkSession, d: str) -> DataFrame:
    """200 bytes of every document, spread over its lines."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)
    kept = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(S.uniform_bytes(sizes, 200)).alias("line_no", "keep"))
    return kept.filter("keep").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


_DRAWN = "r AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY md5('0:' || doc_id || ':' || line_no), doc_id, line_no) AS k FROM n)"


@query("sample_random", f"WITH {_L}, {_DRAWN} SELECT doc_id, line_no FROM r WHERE k <= 100")
def sample_random(spark: SparkSession, d: str) -> DataFrame:
    return S.random_rows(_lines(spark, d).select("doc_id", "line_no"), 100)


@query("sample_random_rejects", f"WITH {_L}, {_DRAWN} SELECT doc_id, line_no FROM r WHERE k > 100")
def sample_random_rejects(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", "line_no")
    return S.rejects(rows, S.random_rows(rows, 100), ["doc_id", "line_no"])


@query("line_head", f"WITH {_L} SELECT doc_id, line_no FROM n WHERE i < 50")
def line_head(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).orderBy("doc_id", "line_no").limit(50).select("doc_id", "line_no")


@query("line_numbers", f"WITH {_L} SELECT doc_id, line_no, i FROM n")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("doc_id", "line_no", "i")


@query(
    "line_interleave",
    f"""WITH {_L}, a AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM l JOIN documents USING (doc_id) WHERE lang = 'fr'), b AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM l JOIN documents USING (doc_id) WHERE lang = 'es'),
m AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), u AS (SELECT 0 AS file_no, * FROM a UNION ALL SELECT 1, * FROM b)
SELECT i // 2 * 4 + file_no * 2 + i % 2 AS place, file_no, md5(line) AS line_md5 FROM u, m WHERE i < n // 2 * 2""",
)
def line_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Two files' lines in turns of two, up to the shorter one's whole turns."""
    docs = table(spark, d, "documents")
    parts = [S.numbered(lines(docs.filter(F.col("lang") == lang), keep=("doc_id",)), "doc_id", "line_no").withColumn("file_no", F.lit(k)) for k, lang in enumerate(("fr", "es"))]
    both = parts[0].unionByName(parts[1])
    shortest = both.groupBy("file_no").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    i = F.col("i")
    out = both.join(F.broadcast(shortest), i < F.expr("n div 2 * 2"))
    return out.select((F.floor(i / 2) * 4 + F.col("file_no") * 2 + i % 2).alias("place"), "file_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(
    "sample_diversity",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 60),
r AS (SELECT a.vec_id, round(sum(pow(list_cosine_similarity(a.v, b.v), 2)), 6) AS score FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT vec_id, score FROM r ORDER BY score, vec_id LIMIT 20""",
)
def sample_diversity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return S.diversity_sample(v, 20, 60).select("vec_id", "score")
