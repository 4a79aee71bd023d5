"""Queries: hooks with functions of a caller's, each of which SQL can state too."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import hooks as H
from ..operators import ngrams as G
from ..operators import strings as S
from ..operators.sizes import spread
from ..session import table
from ..stages import scratch
from .graph import _F, _tables
from .ngrams import counts_sql
from .registry import query

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, arg_min(e, vec_id) AS f FROM v GROUP BY label)"


@query("hook_rows", "SELECT n_nationkey, upper(n_name) AS name FROM nation")
def hook_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a sink on the driver got them."""
    got: list[dict] = []
    H.each_row(table(spark, d, "nation").select("n_nationkey", F.upper("n_name").alias("name")), got.append)
    return spark.createDataFrame([(r["n_nationkey"], r["name"]) for r in got], "n_nationkey int, name string").withColumn("n_nationkey", F.col("n_nationkey").cast(dict(table(spark, d, "nation").dtypes)["n_nationkey"]))


def _doubled(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pc.multiply(batch.column(1), 2)], names=["gram", "twice"])


@query("hook_enumeration", f"WITH {counts_sql((3,))} SELECT gram, 2 * sum(cnt)::BIGINT AS twice FROM c GROUP BY gram")
def hook_enumeration(spark: SparkSession, d: str) -> DataFrame:
    keys = G.counts(spread(table(spark, d, "documents"))).groupBy("gram").agg(F.sum("cnt").alias("cnt"))
    return H.enumerated(keys, _doubled, "gram string, twice long")


@query("hook_matches", f"WITH {counts_sql((3,))} SELECT gram, 2 * sum(cnt)::BIGINT AS twice FROM c WHERE regexp_matches(gram, '^[aeiou].[aeiou]$') GROUP BY gram")
def hook_matches(spark: SparkSession, d: str) -> DataFrame:
    keys = G.counts(spread(table(spark, d, "documents"))).groupBy("gram").agg(F.sum("cnt").alias("cnt"))
    return H.matched(keys, "[aeiou].[aeiou]", _doubled, "gram string, twice long")


def _cosine(a, b) -> float:
    import numpy as np

    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@query("hook_similarity", f"WITH {_V} SELECT vec_id, round(list_cosine_similarity(e, f), 6) AS sim FROM v JOIN c USING (label)")
def hook_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    first = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("f"))
    return H.measured(v.join(first, "label"), "e", "f", _cosine).select("vec_id", F.round("sim", 6).alias("sim"))


@query("hook_term_weights", "SELECT p_partkey, round(ln(1 + p_size) / sqrt(pow(ln(1 + p_size), 2) + pow(ln(1 + p_partkey % 9), 2)), 8) AS size, round(ln(1 + p_partkey % 9) / sqrt(pow(ln(1 + p_size), 2) + pow(ln(1 + p_partkey % 9), 2)), 8) AS key FROM part")
def hook_term_weights(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("key"), (F.col("p_partkey") % 9).cast("double"))
    rows = table(spark, d, "part").select("p_partkey", H.reweighted(m, lambda _, x: F.log1p(x), unit=True).alias("m"))
    return rows.select("p_partkey", F.round(F.element_at("m", "size"), 8).alias("size"), F.round(F.element_at("m", "key"), 8).alias("key"))


@query("hook_groups", "SELECT p_brand, round(max(p_size) - min(p_size), 6)::DOUBLE AS result FROM part GROUP BY p_brand")
def hook_groups(spark: SparkSession, d: str) -> DataFrame:
    return H.grouped(table(spark, d, "part"), ["p_brand"], "p_size", lambda v: v.max() - v.min())


@query("hook_conflicts", "WITH b AS (SELECT DISTINCT a.label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 50 AND a.label = b.label WHERE a.vec_id < 20) SELECT vec_id, label AS cluster FROM embeddings WHERE label NOT IN (SELECT label FROM b)")
def hook_conflicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return H.conflict_free(v, v.filter("vec_id < 20").select(F.col("vec_id").alias("one"), (F.col("vec_id") + 50).alias("two"))).select("vec_id", "cluster")


@query("hook_inheritance", f"""WITH {_F}, u AS (SELECT src, dst, 1 AS depth FROM i UNION SELECT a.src, b.dst, 2 FROM i a JOIN i b ON a.dst = b.src), e AS (SELECT *, 0 AS depth FROM f UNION ALL SELECT src, slot, facet, pos, filler, depth FROM u JOIN f ON frame = dst)
SELECT frame, slot, facet, filler, depth FROM (SELECT *, max(depth) OVER (PARTITION BY frame, slot, facet) AS far FROM e) WHERE depth = far""")
def hook_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Inheritance by a rule of one's own: the farthest ancestor."""
    frames, is_a, _ = _tables(spark, d)
    return H.inherited_with(frames, R.ancestors(is_a), -F.col("depth")).select("frame", "slot", "facet", "filler", "depth")


def _lengths(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.utf8_length(batch.column(1)), pa.int64())], names=["doc_id", "chars"])


@query("hook_work", "SELECT doc_id, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def hook_work(spark: SparkSession, d: str) -> DataFrame:
    return H.worked(spread(table(spark, d, "documents")).filter("text is not null").select("doc_id", "text"), _lengths, "doc_id long, chars long")


class LongWords(H.Scanner):
    """The words of over twelve letters."""

    schema = "doc_id long, found string"

    def scan(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        import re

        pairs = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in re.findall("[A-Za-z]{13,}", t or "")]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["doc_id", "found"])


@query("hook_scanner", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{13,}')) AS found FROM documents")
def hook_scanner(spark: SparkSession, d: str) -> DataFrame:
    return H.scanned(spread(table(spark, d, "documents")).select("doc_id", "text"), [LongWords()])["LongWords"]


@query("hook_batches", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def hook_batches(spark: SparkSession, d: str) -> DataFrame:
    """A stream of a table whose batches a sink of one's own writes."""
    source, path = table(spark, d, "nation"), scratch(spark, "batches")
    stream = spark.readStream.schema(source.schema).parquet(_folder(spark, source))
    H.each_batch(stream, lambda df, k: df.write.parquet(f"{path}/b={k}"), scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


def _folder(spark: SparkSession, rows: DataFrame) -> str:
    """rows as a folder of Parquet files that a stream can read."""
    path = scratch(spark, "stream")
    rows.write.parquet(path)
    return path
